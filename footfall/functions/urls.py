"""Paths, query strings, campaigns and referrers as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that say how someone arrived, and tracking noise; neither names a page.
CAMPAIGN_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform",
    "gclid", "gbraid", "wbraid", "fbclid", "msclkid", "ttclid", "twclid", "dclid", "mc_cid", "mc_eid",
)
NOISE_PARAMS = ("gad_source", "gad_campaignid", "gclsrc", "srsltid", "_gl", "_ga", "_gac", "_gid", "token")
# End of fixed values.

CONTROL = r"[\x00-\x1F\x7F]"


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def cleaned(x: Column, length: int, lower: bool = False) -> Column:
    """Trimmed, without control characters, cut to `length` characters; null becomes empty."""
    value = F.regexp_replace(F.trim(text_or_empty(x)), CONTROL, "")
    return F.left(F.lower(value) if lower else value, F.lit(length))


def query_params(query: Column) -> Column:
    """array<struct<k, v>> of a query string: decoded, of equal names the last, names without leading `amp;`."""
    parts = F.filter(F.split(text_or_empty(query), "&"), lambda p: p != "")

    def decoded(p: Column) -> Column:
        key = text_or_empty(F.try_url_decode(F.substring_index(p, "=", 1)))
        value = F.when(p.contains("="), F.substring(p, F.locate("=", p) + 1, F.length(p))).otherwise("")
        name = F.regexp_replace(F.regexp_replace(key, "^(?:amp;)+", ""), "[. ]", "_")
        return F.struct(name.alias("k"), F.coalesce(F.try_url_decode(value), value).alias("v"))

    every = F.transform(parts, decoded)
    return F.filter(
        every,
        lambda x, i: (x["k"] != "") & ~F.exists(F.slice(every, i + 2, F.size(every)), lambda later: later["k"] == x["k"]),
    )


def param(params: Column, name: str) -> Column:
    """Value of one parameter, or null."""
    return F.get(F.filter(params, lambda x: x["k"] == name), F.lit(0))["v"]


def normalize_path(path: Column, query: Column, exclude: tuple[str, ...] = (), strip_query: bool = False) -> Column:
    """One spelling for a page: a leading slash, no arrival or noise parameters, the rest sorted by name."""
    base = F.concat(F.lit("/"), F.regexp_replace(text_or_empty(path), "^/+", ""))
    if strip_query:
        return base
    left_out = [*exclude, *CAMPAIGN_PARAMS, *NOISE_PARAMS]
    kept = F.array_sort(F.filter(query_params(query), lambda x: ~x["k"].isin(left_out)))
    pairs = F.transform(kept, lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"])))
    return F.when(F.size(pairs) > 0, F.concat(base, F.lit("?"), F.array_join(pairs, "&"))).otherwise(base)


def beacon_path(path: Column, base_path: str = "", page_trigger: str = "p") -> Column:
    """A browser's path as the server would see it: decoded once, slashes folded, site base and page number off."""
    decoded = F.coalesce(F.try_url_decode(F.replace(text_or_empty(path), F.lit("+"), F.lit("%2B"))), text_or_empty(path))
    value = F.regexp_replace(F.regexp_replace(decoded, "^/+|/+$", ""), "//+", "/")
    if base_path:
        inside = F.concat(value, F.lit("/")).startswith(f"{base_path}/")
        value = F.when(inside, F.regexp_replace(F.substring(value, len(base_path) + 1, 1 << 20), "^/+", "")).otherwise(value)
    if page_trigger and not page_trigger.startswith("?"):
        quoted = "".join("\\" + c if not c.isalnum() else c for c in page_trigger)
        value = F.regexp_replace(value, f"^(?:(.*)/)?{quoted}[0-9]+$", "$1")
    return value


def usable_path(path: Column) -> Column:
    """Whether a reported path looks like one."""
    return (
        path.isNotNull() & (F.octet_length(path) <= 1024) & path.startswith("/")
        & ~path.contains("\n") & ~path.contains("\r") & ~path.contains("://")
    )


def campaign(query: Column) -> Column:
    """struct<s, m, c, t, o> from utm parameters, null without a source."""
    params = query_params(query)
    names = {"s": "utm_source", "m": "utm_medium", "c": "utm_campaign", "t": "utm_term", "o": "utm_content"}
    found = F.struct(*(cleaned(param(params, v), 200, lower=True).alias(k) for k, v in names.items()))
    return F.when(found["s"] != "", found)


def campaign_key(c: Column) -> Column:
    return F.concat_ws("|", *(c[k] for k in "smcto"))


def referrer_host(referrer: Column) -> Column:
    host = F.try_parse_url(referrer, F.lit("HOST"))
    return F.when(text_or_empty(host) != "", F.lower(F.regexp_replace(host, r"^\.+", "")))


def external_referrer(referrer: Column, own_hosts: tuple[str, ...]) -> Column:
    """Empty where the referrer is one of the site's own hosts."""
    host = referrer_host(referrer)
    own = host.isin([h.lower() for h in own_hosts]) if own_hosts else F.lit(False)
    return F.when(text_or_empty(referrer) == "", "").when(F.coalesce(own, F.lit(False)), "").otherwise(referrer)


def search_term(path: Column, query: Column, search_path: str = "/search", name: str = "q") -> Column:
    """The site-search term of a hit, null where there is none."""
    here = F.regexp_replace(path, "/+$", "") == search_path.rstrip("/")
    term = cleaned(param(query_params(query), name), 200, lower=True)
    return F.when(here & (term != ""), term)


def glob(pattern: str) -> str:
    """Regular expression of a shell glob; `*` crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() and c not in "_ " else c
        i += 1
    return f"^{out}$"
