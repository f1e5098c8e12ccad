"""Code 128 and Code 39 labels: widths of bars and gaps to symbols, checksum and text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Start symbols of the code sets, switches, shift and the symbol without text.
START = {"A": 103, "B": 104, "C": 105}
TO_C, TO_B, TO_A, SHIFT, FNC1 = 99, 100, 101, 98, 102

# Widths of bars and gaps of the symbols 0 to 105 and of the stop symbol, in modules.
WIDTHS = """
212222 222122 222221 121223 121322 131222 122213 122312 132212 221213 221312 231212 112232 122132 122231 113222 123122 123221 223211 221132
221231 213212 223112 312131 311222 321122 321221 312212 322112 322211 212123 212321 232121 111323 131123 131321 112313 132113 132311 211313
231113 231311 112133 112331 132131 113123 113321 133121 313121 211331 231131 213113 213311 213131 311123 311321 331121 312113 312311 332111
314111 221411 431111 111224 111422 121124 121421 141122 141221 112214 112412 122114 122411 142112 142211 241211 221114 413111 241112 134111
111242 121142 121241 114212 124112 124211 411212 421112 421211 212141 214121 412121 111143 111341 131141 114113 114311 411113 411311 113141
114131 311141 411131 211412 211214 211232
""".split()
STOP = "2331112"
# Bars and gaps of Code 39 letters, n narrow and w wide.
LETTERS = {
    "0": "nnnwwnwnn", "1": "wnnwnnnnw", "2": "nnwwnnnnw", "3": "wnwwnnnnn", "4": "nnnwwnnnw", "5": "wnnwwnnnn", "6": "nnwwwnnnn", "7": "nnnwnnwnw",
    "8": "wnnwnnwnn", "9": "nnwwnnwnn", "A": "wnnnnwnnw", "B": "nnwnnwnnw", "C": "wnwnnwnnn", "D": "nnnnwwnnw", "E": "wnnnwwnnn", "F": "nnwnwwnnn",
    "G": "nnnnnwwnw", "H": "wnnnnwwnn", "I": "nnwnnwwnn", "J": "nnnnwwwnn", "K": "wnnnnnnww", "L": "nnwnnnnww", "M": "wnwnnnnwn", "N": "nnnnwnnww",
    "O": "wnnnwnnwn", "P": "nnwnwnnwn", "Q": "nnnnnnwww", "R": "wnnnnnwwn", "S": "nnwnnnwwn", "T": "nnnnwnwwn", "U": "wwnnnnnnw", "V": "nwwnnnnnw",
    "W": "wwwnnnnnn", "X": "nwnnwnnnw", "Y": "wwnnwnnnn", "Z": "nwwnwnnnn", "-": "nwnnnnwnw", ".": "wwnnnnwnn", " ": "nwwnnnwnn", "*": "nwnnwnwnn",
    "$": "nwnwnwnnn", "/": "nwnwnnnwn", "+": "nwnnnwnwn", "%": "nnnwnwnwn",
}


_SYMBOLS = np.array([[int(c) for c in w] for w in WIDTHS], float)
_STOP = np.array([int(c) for c in STOP], float)
_BITS = 1 << np.arange(9)
_LETTER = np.zeros(512, np.uint8)
for _letter, _shape in LETTERS.items():
    _LETTER[sum(1 << i for i, c in enumerate(_shape) if c == "w")] = ord(_letter)
STAR = ord("*")
_TILE = 512  # windows that are compared at once: their differences stay in a core's cache
_DIGITS = 5 ** np.arange(6.0)
_EXACT = np.full(5**6, -1, np.int32)
_EXACT[(_SYMBOLS @ _DIGITS).astype(int)] = np.arange(len(_SYMBOLS))
_SURE = 0.49 / 6  # two symbols differ by a squared distance of 2 at least: within a quarter of that no other is nearer


def nearest(windows: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Symbol, from first on, nearest to each window of six widths, and its mean squared difference in modules; of equally near ones the first."""
    with np.errstate(invalid="ignore"):
        modules = windows * 11 / windows.sum(axis=1, keepdims=True)
    symbol = _EXACT[(np.clip(np.nan_to_num(np.rint(modules)), 0, 4) @ _DIGITS).astype(int)]
    error = ((modules - _SYMBOLS[symbol]) ** 2).sum(axis=1) / 6
    rest = np.flatnonzero(~((symbol >= first) & (error < _SURE)))
    table = np.ascontiguousarray(_SYMBOLS[first:].T)
    for at in range(0, len(rest), _TILE):
        own = modules[rest[at : at + _TILE]]
        off, d = np.zeros((len(own), table.shape[1])), np.empty((len(own), table.shape[1]))
        for k in range(6):
            np.subtract(own[:, k : k + 1], table[k], out=d)
            np.multiply(d, d, out=d)
            off += d
        off /= 6
        best = off.argmin(axis=1)
        symbol[rest[at : at + _TILE]], error[rest[at : at + _TILE]] = best + first, off[np.arange(len(own)), best]
    return symbol, error


def stop_error(windows: np.ndarray) -> np.ndarray:
    """Mean squared difference of seven widths each from the stop symbol, in modules."""
    return ((windows * 13 / np.maximum(windows.sum(axis=1, keepdims=True), 1e-300) - _STOP) ** 2).mean(axis=1)


def letters(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code 39 letter of each window of nine widths as a code point, 0 where there is none, its narrow width, and how far the worst width is off, in narrow widths."""
    sizes = np.sort(windows, axis=1)
    narrow, wide = sizes[:, :6].mean(axis=1), sizes[:, 6:].mean(axis=1)
    is_wide = windows > ((narrow + wide) / 2)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = wide / narrow
        off = np.abs(windows - np.where(is_wide, wide[:, None], narrow[:, None])).max(axis=1) / narrow
    good = (ratio >= 1.45) & (ratio <= 3.5) & (off <= 0.65)
    return np.where(good, _LETTER[is_wide @ _BITS], 0).astype(np.uint8), narrow, off


def strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of so many of the ASCII bytes each."""
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data, np.uint8)))


def code128_texts(symbols: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of labels that are rows of symbols, so many of each, start symbol to checksum; null where checksum or meaning is wrong.

    All labels move on together, a symbol a step; the rules are those of code128_text.
    """
    n, width = symbols.shape
    own = np.where(np.arange(width) < counts[:, None], symbols, 0).astype(np.int64)
    check = own[np.arange(n), counts - 1]
    weights = np.maximum(np.arange(width), 1)
    ok = ((own @ weights - check * weights[counts - 1]) % 103 == check) & (own[:, 0] >= START["A"])
    a, b, c = range(3)
    mode, shift, size = own[:, 0] - START["A"], np.full(n, -1), np.zeros(n, np.int64)
    out = np.zeros((n, 2 * width), np.uint8)
    for k in range(1, width):
        at = np.flatnonzero(ok & (k < counts - 1))
        if not len(at):
            break
        v, old = own[at, k], mode[at]
        now = np.where(shift[at] >= 0, shift[at], old)
        pair = (now == c) & (v <= 99)
        single = (now != c) & (v <= 95) & ((now == b) | (v < 64))
        other = ~pair & ~single & ~((now == a) & (v >= 64) & (v <= 95))
        turns = [other & (v == TO_C), other & (v == TO_B) & (old != b), other & (v == TO_A) & (old != a)]
        turned = other & (v == SHIFT) & (old != c)
        ok[at] = pair | single | turns[0] | turns[1] | turns[2] | turned | (other & (v == FNC1))
        mode[at] = np.select(turns, [c, b, a], old)
        shift[at] = np.where(turned, b - old, -1)  # a and b are 0 and 1
        put = at[pair | single]
        out[put, size[put]] = np.where(pair, v // 10 + ord("0"), v + 32)[pair | single]
        out[at[pair], size[at[pair]] + 1] = v[pair] % 10 + ord("0")
        size[at] += np.where(pair, 2, single)
    inked = (out != ord(" ")) & (np.arange(2 * width) < size[:, None])
    ok &= inked.any(axis=1)
    begin, end = inked.argmax(axis=1), 2 * width - inked[:, ::-1].argmax(axis=1)
    sizes = np.where(ok, end - begin, 0)
    text = strings(out[ok[:, None] & (np.arange(2 * width) >= begin[:, None]) & (np.arange(2 * width) < end[:, None])], sizes)
    return pc.if_else(pa.array(ok), text, pa.scalar(None, pa.string()))


def _lists(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Sizes, -1 where null, and elements."""
    return pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists)


def _widths(symbols: pa.Array) -> tuple[np.ndarray, Callable[[np.ndarray, int], np.ndarray]]:
    """Sizes of symbols, and what gives the widths of some that are of one size; missing widths are NaN."""
    sizes, flat = _lists(symbols)
    widths = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    counts = np.maximum(sizes, 0)
    begin = np.cumsum(counts) - counts
    return sizes, lambda at, size: widths[begin[at][:, None] + np.arange(size)]


def _symbols(labels: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of labels: counts of symbols; of symbols: their label, and whether they are its first and last; the symbols."""
    counts, flat = _lists(labels)
    counts = np.maximum(counts, 0)
    ends = np.cumsum(counts)
    place = np.arange(len(flat))
    owner = np.repeat(np.arange(len(counts)), counts)
    return counts, owner, place == (ends - counts)[owner], place == ends[owner] - 1, flat


def _near(windows: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """As nearest, with symbol -1 where none is near."""
    symbol, error = np.full(len(windows), -1, np.int32), np.full(len(windows), np.nan)
    wide = np.flatnonzero(windows.sum(axis=1) >= 8)
    found, off = nearest(windows[wide], first)
    near = off <= 0.22
    symbol[wide[near]], error[wide[near]] = found[near], off[near]
    return symbol, error


def _symbol_of(first: int):
    def read(symbols: pa.Array) -> pa.Array:
        sizes, widths = _widths(symbols)
        value, error = np.full(len(sizes), -1, np.int32), np.zeros(len(sizes))
        six = np.flatnonzero(sizes == 6)
        value[six], error[six] = _near(widths(six, 6), first)
        return pa.StructArray.from_arrays([pa.array(error), pa.array(value)], names=["error", "value"], mask=pa.array(value < 0))

    return F.arrow_udf(read, T.StructType([T.StructField("error", T.DoubleType()), T.StructField("value", T.IntegerType())]))


def _code128_labels(labels: pa.Array) -> pa.Array:
    """Texts of labels; null where a rule is broken."""
    counts, owner, head, last, flat = _symbols(labels)
    sizes, widths = _widths(flat)
    value = np.full(len(owner), -1, np.int32)
    whole = ((counts >= 4) & (counts <= 161))[owner]
    at = np.flatnonzero(whole & head & (sizes == 6))
    own = widths(at, 6)
    module = np.full(len(counts), np.nan)
    module[owner[at]] = own.sum(axis=1) / 11
    value[at] = _near(own, START["A"])[0]
    at = np.flatnonzero(whole & last & (sizes == 7))
    value[at[stop_error(widths(at, 7)) < 0.2]] = 0
    at = np.flatnonzero(whole & ~head & ~last & (sizes == 6))
    own = widths(at, 6)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = own.sum(axis=1) / 11 / module[owner[at]]
    near = (ratio > 0.6) & (ratio < 1.5)
    symbol = _near(own[near], 0)[0]
    value[at[near]] = np.where(symbol < START["A"], symbol, -1)
    sound = (counts > 0) & (np.bincount(owner[value < 0], minlength=len(counts)) == 0)
    counts = counts[sound] - 1
    symbols = np.zeros((len(counts), counts.max(initial=1)), np.int32)
    symbols[np.arange(symbols.shape[1]) < counts[:, None]] = value[sound[owner] & ~last]
    place = np.where(sound, np.cumsum(sound) - 1, -1)
    return code128_texts(symbols, counts).take(pa.array(place, mask=~sound))


def _letter_of(symbols: pa.Array) -> pa.Array:
    letter, score = _scored(symbols)
    return pa.StructArray.from_arrays([strings(letter[letter > 0], (letter > 0).astype(np.int64)), pa.array(score)], names=["letter", "score"], mask=pa.array(letter == 0))


def _scored(symbols: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of symbols, 0 where there is none, and scores."""
    sizes, widths = _widths(symbols)
    letter, score = np.zeros(len(sizes), np.uint8), np.zeros(len(sizes))
    nine = np.flatnonzero(sizes == 9)
    own = widths(nine, 9)
    some = own.min(axis=1, initial=np.inf) > 0
    letter[nine[some]], _, off = letters(own[some])
    score[nine[some]] = 1 - off / 2
    return letter, score


def _code39_texts(labels: pa.Array) -> pa.Array:
    """Texts and least scores of labels; null where a letter breaks a rule."""
    counts, owner, head, last, flat = _symbols(labels)
    letter, score = _scored(flat)
    wrong = (letter == 0) | ((letter == STAR) != (head | last))
    sound = (counts >= 3) & (counts <= 100) & (np.bincount(owner[wrong], minlength=len(counts)) == 0)
    least = np.full(len(counts), np.inf)
    np.minimum.at(least, owner, score)
    text = strings(letter[sound[owner] & ~head & ~last], np.where(sound, counts - 2, 0))
    return pa.StructArray.from_arrays([text, pa.array(least)], names=["text", "score"], mask=pa.array(~sound))


def _scored_text(name: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()), T.StructField("score", T.DoubleType())])


def code128_symbol(widths: Column, start: bool = False) -> Column:
    """struct(error, value) of the nearest symbol to six widths; null when none is near, or they aren't six.

    start: among the three start symbols only.  Of equally near ones the first.
    """
    return _symbol_of(START["A"] if start else 0)(widths.cast("array<double>"))


def code128_label(symbols: Column) -> Column:
    """Text of the widths of a whole label, start symbol to stop symbol; null where a rule of the code is broken.

    symbols: an array of six widths each, the last of seven.  Every symbol is
    near one of the table, none after the first is a start symbol, its modules
    stay within 0.6 to 1.5 of the first one's, and the checksum holds.
    """
    return F.arrow_udf(_code128_labels, T.StringType())(symbols.cast("array<array<double>>"))


def code39_letter(widths: Column) -> Column:
    """struct(letter, score) of nine widths, six narrow and three wide; null when they aren't such or no letter has them."""
    return F.arrow_udf(_letter_of, _scored_text("letter"))(widths.cast("array<double>"))


def code39_label(symbols: Column) -> Column:
    """struct(text, score) of an array of nine widths each, from star to star; the least score; null where a rule is broken.

    There are 1 to 98 letters, stars only at the ends.
    """
    return F.arrow_udf(_code39_texts, _scored_text("text"))(symbols.cast("array<array<double>>"))


def code128_check(start: Column, values: Column) -> Column:
    """Checksum of a start symbol and the values that follow."""
    weighted = F.transform(values, lambda v, i: v.cast("long") * (i + 1))
    return (F.aggregate(weighted, start.cast("long"), lambda a, v: a + v) % 103).cast("int")


def code128_text(start: Column, values: Column) -> Column:
    """Text of the values between start and checksum; null when a value has no meaning there or nothing is left."""
    first = F.when(start == START["A"], "A").when(start == START["B"], "B").when(start == START["C"], "C")

    def step(acc, v):
        now = F.when(acc["shift"] != "", acc["shift"]).otherwise(acc["mode"])
        letter = F.when((now == "C") & (v <= 99), F.lpad(v.cast("string"), 2, "0")).when((now != "C") & (v <= 95) & ((now == "B") | (v < 64)), F.char(v + 32))
        control = (now == "A") & v.between(64, 95)
        turn = F.when(letter.isNotNull() | control, None).when(v == TO_C, "C").when((v == TO_B) & (acc["mode"] != "B"), "B").when((v == TO_A) & (acc["mode"] != "A"), "A")
        shift = F.when((v == SHIFT) & letter.isNull(), F.when(acc["mode"] == "A", "B").when(acc["mode"] == "B", "A"))
        ok = acc["ok"] & ~control & (letter.isNotNull() | turn.isNotNull() | shift.isNotNull() | (v == FNC1))
        return F.struct(F.coalesce(turn, acc["mode"]).alias("mode"), F.coalesce(shift, F.lit("")).alias("shift"), F.concat(acc["text"], F.coalesce(letter, F.lit(""))).alias("text"), ok.alias("ok"))

    start_state = F.struct(first.alias("mode"), F.lit("").alias("shift"), F.lit("").alias("text"), first.isNotNull().alias("ok"))
    text = F.aggregate(values, start_state, step, lambda a: F.when(a["ok"], F.regexp_replace(a["text"], r"(?U)^\s+|\s+$", "")))
    return F.nullif(text, F.lit(""))
