"""Column builders for names, headings and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved device names, the heading and its look-alikes.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
HEADING = "RECEIVINGREPORTNO"
LOOKALIKES = ("01L|!58", "OIIIISB")


def safe_filename(name: Column) -> Column:
    """A name that any file system takes; null when nothing is left."""
    text = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    text = F.substring(F.btrim(text, F.lit(" .")), 1, 100)
    device = F.upper(F.substring_index(text, ".", 1)).isin(*RESERVED)
    return F.when(text != "", F.when(device, F.concat(F.lit("_"), text)).otherwise(text))


def heading_text(raw: Column) -> Column:
    """Letters and digits in capitals, look-alikes as letters."""
    return F.translate(F.regexp_replace(F.upper(raw), "[^A-Z0-9|!]", ""), *LOOKALIKES)


def infix_distance(text: Column, pattern: str, most: int) -> Column:
    """Fewest edits from a piece of text to pattern; most + 1 when more than most."""
    m = len(pattern)
    lengths = range(max(m - most, 1), m + most + 1)

    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
        return F.transform(starts, lambda a: F.levenshtein(F.substring(text, a, F.lit(n)), F.lit(pattern)))

    each = [pieces(n) for n in lengths]
    return F.least(F.array_min(F.concat(*each)), F.lit(most + 1))


def heading_distance(text: Column) -> Column:
    """Edits to the heading, 17 when its last letters are too far off."""
    tail = infix_distance(text, HEADING[-8:], 1)
    return F.when(tail > 1, len(HEADING)).otherwise(infix_distance(text, HEADING, 3))


def _near(text: Column, pattern: str, most: int, blocks: tuple[str, ...]) -> Column:
    """infix_distance near the places of blocks alone: of most + 1 blocks of pattern an edited one has at least one as it is."""
    width = len(pattern) + most
    pieces = F.split(text, f"(?={'|'.join(blocks)})", -1)
    starts = F.aggregate(pieces, F.array(F.lit(1)), lambda found, x: F.array_append(found, F.element_at(found, -1) + F.length(x)))
    windows = F.transform(starts, lambda s: F.substring(text, F.greatest(s - width, F.lit(1)), F.lit(2 * width + len(pattern))))
    return F.array_min(F.transform(windows, lambda w: infix_distance(w, pattern, most)))


def strip_distance(text: Column) -> Column:
    """heading_distance of one strip's heading_text, of any length: looked at closer only where half of the last letters are as they should be."""
    tail = _near(text, HEADING[-8:], 1, ("REPO", "RTNO"))
    found = F.when(tail > 1, len(HEADING)).otherwise(_near(text, HEADING, 3, ("RECE", "IVIN", "GREP", "ORTNO")))
    return F.when(text.rlike("REPO|RTNO"), found).otherwise(len(HEADING))


def heading_line_distance(text: Column) -> Column:
    """Least heading_distance of the lines of a text of any length."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n", -1), heading_text)
    return F.coalesce(F.array_min(F.transform(lines, strip_distance)), F.lit(len(HEADING)))


def natural_key(name: Column) -> Column:
    """Orders B2 before B10: texts case-folded, numbers by value."""
    texts = F.split(F.lower(name), r"\d+", -1)
    digits = F.transform(F.regexp_extract_all(name, F.lit(r"(\d+)"), F.lit(1)), lambda d: F.regexp_replace(d, "^0+(?=.)", ""))
    return F.transform(texts, lambda t, i: F.struct(t.alias("text"), F.coalesce(F.length(F.get(digits, i)), F.lit(-1)).alias("size"), F.coalesce(F.get(digits, i), F.lit("")).alias("digits")))
