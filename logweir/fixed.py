"""Fixed values of the log format.

Everything here is given by the format and by the output texts that existing readers of
these logs expect, so it is stated as plain text and in natural order.
"""

# Level names, most severe first; the position in the list is the severity.
LEVELS = ["EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG"]

# Names used in header timestamps. Matching ignores case.
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# One header line, e.g.
# Thu, 02 Apr 2026 12:00:02 +0200 [ERROR] request="043d54b20b2e8" component="Shop.Cart": text
# Number ranges and names are in the pattern, so that one pass decides all but the calendar.
HEADER_PATTERN = (
    rf"\A(?i:{'|'.join(WEEKDAYS)}), (?:0[1-9]|[12][0-9]|3[01]) (?i:{'|'.join(MONTHS)}) [0-9]{{4}} "
    r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60) [+-](?:[01][0-9]|2[0-3])[0-5][0-9] "
    rf'\[(?:{"|".join(LEVELS)})\] request="[^"]*" component="[^"]*": '
)
LEVEL_BRACKET_POSITION = 33  # 1-based; the date part always has 32 characters

# Text that separates a message from the JSON behind it, tried in this order.
JSON_SEPARATORS = [" - {", " - ["]

# Level of each shortcut key.
LEVEL_SHORTCUTS = {1: "ERROR", 2: "WARNING", 3: "INFO", 4: "DEBUG"}

# Display group per severity.
SEVERITY_CLASSES = {
    "critical": ["EMERGENCY", "ALERT", "CRITICAL"],
    "error": ["ERROR"],
    "warning": ["WARNING"],
    "info": ["NOTICE", "INFO"],
    "debug": ["DEBUG"],
}

DEFAULT_LOG_DIR = "./var/log"
TAIL_BYTES = 64 * 1024
POLL_INTERVAL = "500 milliseconds"

# Labels of the plain-text detail block.
DETAIL_LABELS = {
    "time": "Zeitpunkt:  ",
    "level": "Level:      ",
    "request": "Request:    ",
    "component": "Component:  ",
    "line": "Zeile:      ",
    "json": "JSON:",
    "extra": "Zusätzliche Daten:",
}
SHIFT_NOTE = " (angepasst, %+dh)"

# Texts of the filter description.
DATE_RANGE_LABEL = "{} – {}"
DATE_FROM_LABEL = "ab {}"
DATE_TO_LABEL = "bis {}"
OTHER_FILTER_LABEL = "weiterer Filter"
