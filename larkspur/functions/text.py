"""Column functions on text. Each stays inside the JVM; null in gives null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, and inside, including the no-break space.
EDGE = r"^[\s ]+|[\s ]+$"
SPACE = r"[\s ]+"
#: Characters other than letters, digits, underscores and white space.
PUNCTUATION = r"[^\p{L}\p{N}_\s ]"

# The heading patterns of plain-text documents.
HEADINGS = (r"(?i)^Chapter\s+\d+\s+[^.!?]{3,120}$", r"^\d+(?:\.\d+)+\s+[^.!?]{3,120}$", r"^\d+\.\s+[A-Z][^.!?]{3,120}$")
# National identity numbers.
AADHAAR = r"\b[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}\b"
PAN = r"\b[A-Z]{5}\d{4}[A-Z]\b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at the ends, line ends included."""
    return F.regexp_replace(_col(c), EDGE, "")


def normalize(c: Column | str) -> Column:
    """Joined hyphenations, line ends as \\n, blanks collapsed, stripped; null gives the empty string."""
    joined = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"-\n([\p{L}\p{N}_]+)", "$1")
    return strip(F.regexp_replace(F.regexp_replace(joined, r"\r", "\n"), r"[ \t]+", " "))


def dedup_key(c: Column | str) -> Column:
    """Lower case, blanks collapsed, punctuation dropped, stripped. A free-standing symbol leaves two blanks."""
    spaced = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), SPACE, " ")
    return strip(F.regexp_replace(spaced, PUNCTUATION, ""))


def sentences(c: Column | str) -> Column:
    """Sentences of a text: cut behind . ! ? that white space follows."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), r"(?<=[.!?])[\s ]+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def is_heading(c: Column | str) -> Column:
    """Whether a line reads as a numbered heading."""
    text = strip(c)
    return F.coalesce(text.rlike(HEADINGS[0]) | text.rlike(HEADINGS[1]) | text.rlike(HEADINGS[2]), F.lit(False))


def paragraphs(c: Column | str) -> Column:
    """Paragraphs between blank lines, line ends inside them kept; a blank text is one paragraph, itself."""
    text = F.coalesce(_col(c), F.lit(""))
    blocks = F.filter(F.transform(F.split(text, r"\n[\s\u00a0]*\n"), strip), lambda s: s != "")
    return F.when(F.size(blocks) > 0, blocks).otherwise(F.array(text))


def overlap_tail(c: Column | str, overlap: int) -> Column:
    """The last ``overlap`` characters from the first word start on; the whole text if it is no longer."""
    text = _col(c)
    tail = F.substring(text, -overlap, overlap) if overlap > 0 else F.lit("")
    space = F.locate(" ", tail)
    cut = F.when(space > 1, F.substr(tail, space + 1)).otherwise(tail)
    return F.when(F.length(text) <= overlap, text).otherwise(strip(cut))


def content_hash(c: Column | str) -> Column:
    """SHA-1 of the stripped content."""
    return F.sha1(strip(c).cast("binary"))


def query_key(c: Column | str) -> Column:
    """A question as it is looked up in caches: blanks collapsed, lower case."""
    return F.lower(strip(F.regexp_replace(_col(c), SPACE, " ")))


def alias_name(c: Column | str) -> Column:
    """Name of the live alias of a collection."""
    return F.concat(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9_-]", "_"), F.lit("_live"))


def ascii_json(c: Column | str) -> Column:
    """JSON text with every character beyond ASCII as an escape of lower-case hex digits, two for those beyond 16 bits."""
    text = _col(c)
    escaped = lambda x: F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(.{4})", r"\\u$1")
    letters = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))
    whole = F.array_join(F.transform(letters, lambda x: F.when(F.ascii(x) > 127, escaped(x)).otherwise(x)), "")
    return F.when(text.rlike(r"[^\x00-\x7f]"), whole).otherwise(text)


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([\p{L}\p{N}]+)"), 1)


def file_extension(c: Column | str) -> Column:
    """The suffix of a file name with its dot, lower case; empty without one."""
    return F.lower(F.regexp_extract(_col(c), r"(\.[^./\\]+)$", 1))


def normalized_tags(c: Column | str) -> Column:
    """Tags in lower case, blanks collapsed and stripped, the first of equal ones kept, blank ones dropped."""
    clean = F.transform(_col(c), lambda t: F.lower(strip(F.regexp_replace(t, SPACE, " "))))
    return F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != "")))
