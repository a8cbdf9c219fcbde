"""Channels, devices, crawlers and visitor identity as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.urls import referrer_host, text_or_empty

# Channels and device types by number, host fragments by channel, user-agent markers.
CHANNELS = {"Direct": 0, "Search": 1, "Social": 2, "Referral": 3, "Campaign": 4, "Internal": 5}
DEVICE_TYPES = {"Unknown": 0, "Desktop": 1, "Mobile": 2, "Tablet": 3}
SEARCH_HOSTS = (
    "google.", "bing.com", "duckduckgo.com", "search.yahoo.", "yandex.", "baidu.com", "ecosia.org", "startpage.com",
    "brave.com", "qwant.com", "search.marginalia.nu", "searx.", "lite.duckduckgo.com", "perplexity.ai",
)
SOCIAL_HOSTS = (
    "facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com", "t.co", "linkedin.com", "lnkd.in", "reddit.com",
    "out.reddit.com", "pinterest.", "youtube.com", "youtu.be", "tiktok.com", "threads.net", "threads.com", "mastodon.",
    "bsky.app", "bsky.social", "tumblr.com", "quora.com", "whatsapp.com", "telegram.org", "t.me", "discord.com",
    "news.ycombinator.com",
)
TABLET_MARKERS = ("ipad", "tablet", "playbook", "silk", "kindle")
MOBILE_MARKERS = ("mobile", "iphone", "ipod", "android", "phone", "blackberry", "opera mini")
AUTOMATION_MARKERS = (
    "headlesschrome", "phantomjs", "electron/", "puppeteer", "playwright", "selenium", "webdriver", "cypress",
    "lighthouse", "chrome-lighthouse", "pagespeed",
)
# End of fixed values.

#: Crawler names as they appear in user agents: a general rule, no list of every crawler.
CRAWLER = r"(?i)\b([a-z0-9._-]*(?:bot|crawler|spider|slurp|fetcher|archiver)[a-z0-9._-]*)"
MAX_MAJOR = 999

BROWSERS = (
    ("Edge", r"(?:Edg|Edge|EdgA|EdgiOS)/(\d+)"),
    ("Opera", r"(?:OPR|Opera)/(\d+)"),
    ("Samsung Browser", r"SamsungBrowser/(\d+)"),
    ("Firefox", r"(?:Firefox|FxiOS)/(\d+)"),
    ("Chrome", r"(?:Chrome|CriOS)/(\d+)"),
    ("Safari", r"Version/(\d+)[^ ]* (?:Mobile/\S+ )?Safari"),
    ("Internet Explorer", r"(?:MSIE |rv:)(\d+)"),
)
SYSTEMS = (
    ("iPad", "iPad"), ("iPhone", "iPhone"), ("Android", "Android"), ("Chrome OS", "CrOS"), ("Windows", "Windows"),
    ("Macintosh", "Macintosh"), ("Linux", "Linux"),
)


def host_pattern(fragment: str) -> str:
    """A fragment is the host or a parent of it; with a trailing dot, any ending may follow it."""
    quoted = fragment.rstrip(".").replace(".", r"\.")
    return rf"(^|\.){quoted}\.|^{quoted}$" if fragment.endswith(".") else rf"(^|\.){quoted}$"


def channel_of_host(host: Column, extra: tuple[tuple[str, str], ...] = ()) -> Column:
    """Channel number of a referring host; the first rule that matches decides, extra ones come last."""
    rules = [*((h, "Search") for h in SEARCH_HOSTS), *((h, "Social") for h in SOCIAL_HOSTS), *extra]
    out, i = F.when(host.isNull(), CHANNELS["Direct"]), 0
    while i < len(rules):  # neighbours of one channel share an expression
        j = i
        while j < len(rules) and rules[j][1] == rules[i][1]:
            j += 1
        out = out.when(host.rlike("|".join(host_pattern(h) for h, _ in rules[i:j])), CHANNELS[rules[i][1]])
        i = j
    return out.otherwise(CHANNELS["Referral"])


def channel(referrer: Column, has_campaign: Column, extra: tuple[tuple[str, str], ...] = ()) -> Column:
    return F.when(has_campaign, CHANNELS["Campaign"]).otherwise(channel_of_host(referrer_host(referrer), extra))


def label(number: Column, names: dict[str, int]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, i in names.items():
        out = out.when(number == i, name)
    return out


def _contains_any(x: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | x.contains(m)
    return out


def device(user_agent: Column) -> Column:
    """struct<browser, major, os, type>; implausible versions count as 0."""
    ua, browser, major = text_or_empty(user_agent), F.lit("Unknown"), F.lit("")
    for name, pattern in reversed(BROWSERS):
        hit = ua.rlike(pattern)
        browser = F.when(hit, name).otherwise(browser)
        major = F.when(hit, F.regexp_extract(ua, pattern, 1)).otherwise(major)
    system = F.lit("Unknown")
    for name, marker in reversed(SYSTEMS):
        system = F.when(ua.contains(marker), name).otherwise(system)
    number = F.when(F.length(major).between(1, 3), major.try_cast("int"))
    low = F.lower(ua)
    kind = (
        F.when(ua == "", DEVICE_TYPES["Unknown"])
        .when(_contains_any(low, TABLET_MARKERS), DEVICE_TYPES["Tablet"])
        .when(_contains_any(low, MOBILE_MARKERS), DEVICE_TYPES["Mobile"])
        .when(system == "Unknown", DEVICE_TYPES["Unknown"])
        .otherwise(DEVICE_TYPES["Desktop"])
    )
    return F.struct(browser.alias("browser"), F.coalesce(number, F.lit(0)).alias("major"), system.alias("os"), kind.alias("type"))


def edge_says_bot(score: Column | None, threshold: int) -> Column:
    return F.lit(False) if score is None else F.coalesce(score.try_cast("double") <= threshold, F.lit(False))


def is_bot(user_agent: Column, webdriver: Column | None = None, score: Column | None = None, threshold: int = 30) -> Column:
    ua = text_or_empty(user_agent)
    driven = F.lit(False) if webdriver is None else F.coalesce(webdriver, F.lit(False))
    return driven | (ua == "") | ua.rlike(CRAWLER) | _contains_any(F.lower(ua), AUTOMATION_MARKERS) | edge_says_bot(score, threshold)


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 20))


def crawler_name(user_agent: Column, score: Column | None = None, threshold: int = 30) -> Column:
    ua = text_or_empty(user_agent)
    name = F.regexp_extract(ua, CRAWLER, 1)
    out = F.when(ua == "", "Unknown").when(name != "", _capital(F.left(name, F.lit(100))))
    for m in AUTOMATION_MARKERS:
        out = out.when(F.lower(ua).contains(m), m[0].upper() + m[1:])
    return out.when(edge_says_bot(score, threshold), "Data-centre (edge)").otherwise("Unrecognised automation")


def visitor_hash(salt: Column, address: Column, user_agent: Column, site: Column) -> Column:
    """16 hexadecimal digits that mean nothing without the salt of their day."""
    return F.substring(F.sha2(F.concat_ws("|", salt, address, user_agent, site.cast("string")), 256), 1, 16)


def session_key(visitor: Column, site: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", visitor, site.cast("string")), 256), 1, 32)


def valid_visitor(visitor: Column, kind: Column, sentinel: str = "crawler") -> Column:
    """16 hexadecimal digits; the crawlers' sentinel only on crawler hits."""
    return visitor.rlike("^[0-9A-Fa-f]{16}$") | ((visitor == sentinel) & (kind == "crawler"))


def salt_epoch(ts: Column, timezone: str, interval: int = 86_400, hour: int = 4) -> Column:
    """Number of the salt in force at a time: whole-day intervals turn over at a local hour."""
    local = F.unix_timestamp(F.from_utc_timestamp(ts, timezone))
    shift = hour * 3_600 if interval % 86_400 == 0 else 0
    return F.floor((local - shift) / interval).cast("long")


def local_date(ts: Column, timezone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, timezone))


def local_hour(ts: Column, timezone: str) -> Column:
    return F.hour(F.from_utc_timestamp(ts, timezone))
