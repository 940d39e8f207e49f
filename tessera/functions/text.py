"""Column functions on texts: plain text of HTML, escaping, base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is replaced, in this order (so a doubly escaped '<' stays escaped once).
_STEPS = [
    (r"(?i)<style[\s\S]*?</style>", ""), (r"(?i)<script[\s\S]*?</script>", ""), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"),
    (r"<[^>]+>", ""), (r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"),
]


def html_text(html: Column) -> Column:
    out = html
    for pattern, by in _STEPS:
        out = F.regexp_replace(out, pattern, by)
    return out


def escape_html(value: Column) -> Column:
    out = value
    for mark, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(by))
    return out


def wrapped_base64(content: Column) -> Column:
    """Base64 in lines of 76 characters; Spark's own already breaks them with CR LF."""
    return F.base64(content)
