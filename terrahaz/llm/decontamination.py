"""Benchmark leaks: windows of canonical templates, hash-joined, with a check of what fills their slots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.llm import words
from terrahaz.llm.frames import FILTER_BITS, bitmap, flat, in_bitmap, text_slices

WINDOW = 8
"""Template words of a window; an item with fewer is one window."""
SHARE = 0.5
"""Share of an item's windows that a document must hold."""
MIN_LITERAL = 5
"""Windows with fewer words outside slots are slot-dense; an alignment is also judged without them."""

# fixed values: written numbers and units of measure
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
                "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds ml l liter liters litre litres "
         "gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years meter meters "
         "metre metres gram grams kilogram kilograms kilometer kilometers kilometre kilometres dollar dollars cent cents euro euros percent "
         "degree degrees mph kmh kb mb gb tb hz khz mhz ghz w kw v a").split()
# fixed values: words that open English sentences and are no names
OPENERS = ("the an this that these those he she it we you they his her its our your their my there here who whom whose what which when where why how "
           "is are was were am do does did has have had can could will would shall should may might must let if then so but and or nor not no "
           "as at by for from in into of off on onto out over to under up with without after before during while until since because although "
           "though however each every all any both some many most much more few other another one's once now today also only just first next "
           "finally suppose given consider find calculate compute determine solve show prove explain write give name list").split()

_CORE = np.zeros(256, bool)
_CORE[[b for b in range(128) if chr(b).isalnum()] + list(range(128, 256))] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\"()[]"]] = True
_SLOTS = {name: words.mix(np.array([k], np.uint64))[0] for name, k in (("number", 11), ("name", 12), ("unit", 13))}


def _hashed(names: list[str]) -> np.ndarray:
    data = " ".join(names).encode()
    starts, ends, _ = words.bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return np.sort(words.hashes(np.frombuffer(data, np.uint8), starts, ends))


_NUMBERS, _UNITS, _OPENERS = _hashed(NUMBER_WORDS), _hashed(UNITS), _hashed(OPENERS)


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _before(mask: np.ndarray) -> np.ndarray:
    """How many bytes before each place are marked, in four bytes a place wherever that is enough."""
    total = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, dtype=total.dtype, out=total[1:])
    return total


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Begin and end of words without the bytes around them that are no letters or digits; begin >= end where none are.

    Looks only at the places where such bytes begin and end, which are about as many as the words.
    """
    core = np.zeros(len(data) + 2, bool)
    core[1:-1] = _CORE[data]
    begins, stops = np.flatnonzero(core[1:] & ~core[:-1]), np.flatnonzero(core[:-1] & ~core[1:])
    if not len(begins) or not len(starts):
        return starts, starts
    at = np.searchsorted(begins, starts)
    a = np.where(core[starts + 1], starts, np.append(begins, len(data))[at])
    last = np.searchsorted(stops, ends, "right") - 1
    b = np.where(core[ends], ends, np.where(last >= 0, stops[last], 0))
    return a, np.where(a < ends, b, a)


def canonical(texts: pa.Array):
    """First word of each text (total last), the value of each word, and two forms of (template, whether a word is a slot).

    Punctuation around a word and words without letters or digits do not count. Numbers
    (with a digit, or written) become one placeholder, units behind a number another,
    and names a third: in the first form capitalised words inside a sentence, in the second one
    capitalised words anywhere but ``OPENERS``, so that neither layout nor the place in a
    sentence decides. Words all in capitals are plain words.
    """
    data, offsets = flat(texts)
    starts, ends, _ = words.bounds(data, offsets)
    a, b = _trimmed(data, starts, ends)
    some = b > a
    gap_end = np.append(0, ends)[:-1]  # end of the word before
    starts, ends, a, b, gap = starts[some], ends[some], a[some], b[some], gap_end[some]
    first = np.searchsorted(starts, offsets)
    value = words.hashes(words.LOWER[data], a, b)

    def counted(mask):
        total = _before(mask)
        return total[b] - total[a]

    digits = counted((data >= 48) & (data <= 57))
    lower = counted((data >= 97) & (data <= 122) | (data >= 128))
    head = data[a] if len(a) else data[:0]
    following = data[np.minimum(a + 1, len(data) - 1)] if len(a) else head
    capital = (head >= 65) & (head <= 90) | (head == 0xC3) & (following >= 0x80) & (following <= 0x9E)
    opening = np.zeros(len(a), bool)
    opening[first[:-1][first[:-1] < len(a)]] = True
    breaks = _before(data == 10)
    opening |= breaks[a] > breaks[np.minimum(gap, a)]
    del breaks
    if len(a) > 1:
        opening[1:] |= _STOP[data[ends[:-1] - 1]]
    opening |= a > starts  # behind a quotation mark or bracket
    number = (digits > 0) | _among(value, _NUMBERS)
    unit = _among(value, _UNITS)
    unit[1:] &= number[:-1]
    unit[:1] = False
    capital &= (lower > 0) & ~number

    def form(name):
        template = np.where(number, _SLOTS["number"], np.where(unit, _SLOTS["unit"], np.where(name, _SLOTS["name"], value)))
        return template, number | unit | name

    return first, value, [form(capital & ~opening), form(capital & ~_among(value, _OPENERS))]


_INSIDE, _ANYWHERE, _VERBATIM, _DENSE = 1, 2, 4, 8
"""Bits of a window: the forms (see ``canonical``) or values that its hash stands for, and whether it is slot-dense."""


def _windows(value, forms, first, length: int, sieve=None):
    """First words, hashes, bits and slot fillings (packed hashes) of the windows of ``length`` words.

    A window is listed once for each different hash: of its values, and of both forms. Windows of nothing
    but slots have no template words and are listed by their values only.
    """
    at, exact = words.runs(value, first, length)
    hashed, literals = [], []
    for template, slot in forms:
        literal = np.concatenate([[0], np.cumsum(~slot)])
        literals.append(literal[at + length] - literal[at])
        hashed.append(np.where(literals[-1] > 0, words.runs(template, first, length)[1], exact))
    inside, anywhere = hashed
    listed = [
        (np.ones(len(at), bool), exact, _VERBATIM + _INSIDE * (inside == exact) + _ANYWHERE * (anywhere == exact), None, None),
        (inside != exact, inside, _INSIDE + _ANYWHERE * (anywhere == inside), literals[0], forms[0][1]),
        ((anywhere != exact) & (anywhere != inside), anywhere, np.full(len(at), _ANYWHERE), literals[1], forms[1][1]),
    ]
    out = []
    for own, key, bits, literal, slot in listed:
        key = words.mix(key + np.uint64(length))
        keep = np.flatnonzero(own if sieve is None else own & sieve(key))
        if literal is not None:
            bits = bits + _DENSE * (literal < min(MIN_LITERAL, length))
        filled = [b"" if slot is None else value[k:k + length][slot[k:k + length]].tobytes() for k in at[keep].tolist()]
        out.append((at[keep], key[keep], bits[keep].astype(np.int32), filled))
    return *(np.concatenate(x) for x in list(zip(*out))[:3]), [f for x in out for f in x[3]]


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            first, value, forms = canonical(texts)
            sizes = np.diff(first)
            for length in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
                at, hashed, bits, filled = _windows(value, forms, first, length)
                row = np.searchsorted(first, at, "right") - 1
                own = np.flatnonzero(np.minimum(sizes[row], window) == length)
                at, hashed, bits, row, filled = at[own], hashed[own], bits[own], row[own], [filled[k] for k in own.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashed.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array((at - first[row]).astype(np.int32)),
                     pa.array((sizes[row] - length + 1).astype(np.int32)), pa.array(np.full(len(at), length, np.int32)),
                     pa.array(bits), pa.array(filled, pa.binary())],
                    names=["window", "item_id", "item_pos", "n_windows", "length", "item_bits", "item_values"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(
        run, f"window long, item_id {kind}, item_pos int, n_windows int, length int, item_bits int, item_values binary")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, share) of every document that holds a benchmark item.

    Both sides are canonicalised (see ``canonical``) and cut into windows of ``window``
    template words. A bitmap of fixed size lets through the windows that may be
    in the benchmark, an equi-join on the hash decides. Matches of a pair on one diagonal
    (same distance between the places) are one alignment; it counts when its slots are
    consistent: equal fillings of the item have equal fillings in the document, and
    different ones different ones. Windows with equal words always count. A pair is reported when the windows of its
    consistent alignments cover at least ``share`` of the item. Neither side is ever broadcast by order.

    Null and empty texts hold nothing; items without words leak nowhere. Repeated
    rows of one doc_id count as one document, equal items under several item_ids are
    each reported. A null doc_id or item_id is reported as null. Other columns are left out.
    """
    items = _items(benchmark, window)
    lengths = [r["length"] for r in items.select("length").distinct().collect()]  # at most ``window`` numbers
    place = F.pmod("window", F.lit(1 << FILTER_BITS)) + 1
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(items.select(place)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            first, value, forms = canonical(texts)
            for length in lengths:
                at, hashed, bits, filled = _windows(
                    value, forms, first, length,
                    lambda key: in_bitmap(shared.value, (key & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) + 1))
                row = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashed.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array((at - first[row]).astype(np.int32)),
                     pa.array(bits), pa.array(filled, pa.binary())], names=["window", "doc_id", "pos", "doc_bits", "doc_values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"window long, doc_id {kind}, pos int, doc_bits int, doc_values binary")

    def cut(column):
        return f"transform(sequence(0, cast(octet_length({column}) / 8 as int) - 1), i -> substring({column}, i * 8 + 1, 8))"

    fillings = F.expr(f"CASE WHEN octet_length(item_values) = 0 THEN array() ELSE arrays_zip({cut('item_values')}, {cut('doc_values')}) END").cast(
        "array<struct<i:binary,d:binary>>")
    both = F.col("item_bits").bitwiseAND(F.col("doc_bits"))
    lines = found.join(items, "window").where("octet_length(item_values) = octet_length(doc_values)").select(
        "doc_id", "item_id", "n_windows", "item_pos", (F.col("pos") - F.col("item_pos")).alias("diagonal"), fillings.alias("fillings"),
        (both.bitwiseAND(_VERBATIM) > 0).alias("verbatim"), (both.bitwiseAND(_INSIDE) > 0).alias("inside"),
        (both.bitwiseAND(_DENSE) > 0).alias("dense"))
    # an alignment is judged in three ways: by the first form without slot-dense windows, with them, and by both forms
    ways = [F.col("inside") & ~F.col("dense"), F.col("inside"), F.lit(True)]
    # a slot is listed once per window that holds it: sets stay as small as the item
    aligned = lines.groupBy("doc_id", "item_id", "n_windows", "diagonal").agg(
        F.collect_set(F.when(F.col("verbatim"), F.col("item_pos"))).alias("equal"),
        *[F.collect_set(F.when(way, F.col("item_pos"))).alias(f"places{k}") for k, way in enumerate(ways)],
        *[F.flatten(F.collect_set(F.when(way, F.col("fillings")))).alias(f"fillings{k}") for k, way in enumerate(ways)])

    def consistent(k):
        return F.expr(f"size(array_distinct(fillings{k})) = size(array_distinct(transform(fillings{k}, f -> f.i))) AND "
                      f"size(array_distinct(fillings{k})) = size(array_distinct(transform(fillings{k}, f -> f.d)))")

    none = F.array().cast("array<int>")
    places = F.concat("equal", *[F.when(consistent(k), F.col(f"places{k}")).otherwise(none) for k in range(len(ways))])
    matched = aligned.select("doc_id", "item_id", "n_windows", places.alias("places")).groupBy("doc_id", "item_id", "n_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_matched"))
    return matched.withColumn("share", F.col("n_matched") / F.col("n_windows")).where(F.col("share") >= share).select(
        "doc_id", "item_id", "n_matched", "n_windows", "share")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns and repeated rows of the others stay."""
    held = leaks(docs, benchmark, window, share).select(F.col("doc_id").alias("leaked")).distinct()
    return docs.join(held, docs["doc_id"].eqNullSafe(held["leaked"]), "left_anti")
