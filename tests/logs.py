"""Small log texts for the tests."""

from pathlib import Path

STAMP = "Thu, 02 Apr 2026 12:00:02 +0200"


def header(level="INFO", message="msg", request="r1", component="Vendor.Ext", stamp=STAMP):
    return f'{stamp} [{level}] request="{request}" component="{component}": {message}'


def numbered(n, level="INFO", start=1):
    """Header lines ``parcel i weighs .. g`` from van ``i``, three seconds apart."""
    lines = []
    for i in range(start, start + n):
        minute, second = divmod(3 * i, 60)
        stamp = f"Tue, 17 Nov 2026 {6 + minute // 60 % 12:02d}:{minute % 60:02d}:{second:02d} +0100"
        lines.append(header(level, parcel(i), f"van-{i}", "Depot.Scale", stamp) + "\n")
    return "".join(lines)


def parcel(i):
    return f"parcel {i} weighs {137 * i % 900 + 100} g"


def put(folder, name, content):
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode() if isinstance(content, str) else content)
    return path


def rows(df, *columns):
    """Rows of chosen columns ordered by file and line."""
    order = [c for c in ("file", "line_number") if c in df.columns]
    return [tuple(r) for r in df.orderBy(*order).select(*columns).collect()]
