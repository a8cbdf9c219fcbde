"""A server of reports, as tasks would ask one."""

import json


def pages_of_a_report(name, start, end, offset, limit):
    """A report of 25 rows over two months, as its server would give it."""
    rows = [{"dimensionValues": [{"value": f"2026{7 + i // 20:02d}{1 + i % 20:02d}"}, {"value": f"/{i}"}], "metricValues": [{"value": "2"}, {"value": "1"}, {"value": "3"}]} for i in range(25)]
    heads = {"dimensionHeaders": [{"name": "date"}, {"name": "pagePath"}], "metricHeaders": [{"name": n} for n in ("screenPageViews", "userEngagementDuration", "activeUsers")]}
    return json.dumps({**heads, "rows": rows[offset : offset + limit], "rowCount": 25 if name == "pages" else 0})
