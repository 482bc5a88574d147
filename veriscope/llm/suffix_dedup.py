"""Removal of long repeated byte strings: every byte under a string of STRING bytes that also starts anywhere else.

A difference-cover suffix sort, bounded to the prefix that is asked for, over a sampled text:

1. **Cover.** In every window of STRING bytes the least hash of its GRAM-byte strings (the rightmost of equal ones) is an anchor. It depends on the window
   alone, so equal windows have their anchors at equal places: positions that fall together wherever a string repeats, as a difference
   cover's do, at 2 % of all bytes. Anchors are at most SPAN = STRING - GRAM + 1 bytes apart and their strings overlap, so the sequence of anchors spells the text.
   Only anchors whose string occurs at least twice can lie in a repeated window; a bit filter of fixed size lets most others go before
   the join that decides.
2. **Sampled triples.** The repeated anchors of a text are a string of symbols (hash, distance to the next anchor, next hash). At places
   1 and 2 modulo 3 the triples of symbols are counted, sorted and named by their place in the sort; those that occur once are distinct suffixes and are left out.
3. **Recursion.** Where a named triple covers too few bytes, the names are a string of a third of the length for each residue, and the same step names triples of names.
4. **Remaining suffixes.** Places 0 modulo 3 merge with the others by (symbol, name of the next place) against places 1, and by
   (two symbols, name of the place after them) against places 2. Suffixes that share a prefix of the length asked for have equal keys, side by side in the sort: their
   windows are repeated.
5. **Edges.** Windows that steps 2 to 4 leave open (a match that ends within a symbol) are settled by bytes: anchors of one string that have an open window
   among them bring the bytes around them together. Anchors with equal bytes around them are one context: all its windows are repeated, and its bytes
   travel once a task. Windows of different contexts are compared at each distance from the anchor. A string with over LARGE contexts is dealt
   out by its windows instead, each context once, with partial counts.

Equal texts are one text until the end; two or more of at least STRING bytes are removed whole. The suffixes are not put into one total order: only
equality of STRING bytes is asked for, and sorting every byte's suffix would shuffle some 30 x the input.

Symbols and window digests are hashes (64 bits and 128 bits); equal hashes are taken for equal strings.

Defined cases: a null text is empty; texts under STRING bytes lose nothing; strings may overlap themselves; every row gets its result, so rows
that repeat a doc_id (or have none) each count as a document, and equal rows remove each other. Texts are UTF-8 bytes and what is kept need not be
valid UTF-8. Long texts are read whole, in blocks. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, discard
from .bits import bit_filter, passes
from .textfeatures import mixed

STRING, GRAM = 200, 104
SPAN = STRING - GRAM + 1
#: Bytes that are hashed at once, so that tables of powers and temporary arrays stay small.
BLOCK = 1 << 17
LARGE = 2000
#: Contexts that a task remembers, so as not to send their bytes again.
SEEN = 1 << 16
#: Writes a table, as ``cut`` does.
Keep = Callable[[DataFrame, str], DataFrame]
MAX_LEVELS = 5
_LOW = np.uint64((1 << 21) - 1)
_BYTES = np.random.Generator(np.random.PCG64(200)).integers(0, 1 << 63, (2, 256), np.uint64)
_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: ``steps``: bytes from each anchor to the one before it (the first one: from the start); ``backs``: bytes from an anchor back to its first window. Both are at most SPAN.
_TEXTS = "text_key binary, n_bytes long, hashes array<bigint>, steps array<tinyint>, backs array<tinyint>"
_ANCHORS = "tid long, at long, h long, place long, start long, last long, step long, sym long"


@lru_cache(maxsize=2)
def _scales(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a step and of its inverse modulo 2^64, for a block and a string."""
    up, down = (np.full(2 * BLOCK, step, np.uint64) for step in (_STEP[which], pow(_STEP[which], -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def string_hashes(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each string of ``width`` bytes."""
    up, down = _scales(which)
    out = np.zeros(max(0, len(data) - width + 1), np.uint64)
    for at in range(0, len(out), BLOCK):
        part = data[at : at + BLOCK + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[which][part] * up[: len(part)], out=sums[1:])
        found = sums[width:] - sums[:-width]
        out[at : at + len(found)] = mixed(found * down[: len(found)])
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    reach = 1
    while 2 * reach <= width:
        values, reach = np.minimum(values[:-reach], values[reach:]), 2 * reach
    more = width - reach
    return np.minimum(values[: len(values) - more], values[more:]) if more else values


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window) of each anchor: windows from its first one to the next anchor's are its own."""
    windows = len(raw) - STRING + 1
    hashes, places, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, windows, BLOCK):
        n = min(BLOCK, windows - at)
        grams = string_hashes(np.frombuffer(raw, np.uint8, n + STRING - 1, at), GRAM)
        ranked = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
        least = _least(ranked, SPAN)
        first = np.nonzero(np.append(True, least[1:] != least[:-1]))[0]
        inside = (_LOW - (least[first] & _LOW)).astype(np.int64)
        place = inside + at
        if len(places[-1]) and places[-1][-1] == place[0]:
            first, inside, place = first[1:], inside[1:], place[1:]
        hashes.append(grams[inside])
        places.append(place)
        starts.append(first + at)
    return np.concatenate(hashes), np.concatenate(places), np.concatenate(starts)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("text_key"))


def anchored_texts(keyed: DataFrame) -> DataFrame:
    """``(tid, text_key, n_bytes, copies, hashes, steps, backs)`` of each distinct text of at least STRING bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                rows = []
                for text in part.column(1):
                    raw = text.as_py().encode("utf-8", "surrogatepass")
                    h, place, start = anchors(raw)
                    rows.append((len(raw), h.view(np.int64), np.diff(place, prepend=0).astype(np.int8), (place - start).astype(np.int8)))
                size, h, steps, backs = zip(*rows)
                lists = (pa.array(h, pa.list_(pa.int64())), *(pa.array(a, pa.list_(pa.int8())) for a in (steps, backs)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), *lists], ["text_key", "n_bytes", "hashes", "steps", "backs"])

    found = keyed.where(F.octet_length("text") >= STRING).select("text_key", "text").mapInArrow(run, _TEXTS)
    each = found.groupBy("text_key").agg(*[F.first(c).alias(c) for c in ("n_bytes", "hashes", "steps", "backs")], F.count("*").alias("copies"))
    return each.withColumn("tid", F.monotonically_increasing_id())


def hot_anchors(texts: DataFrame, keep: Keep = cut) -> DataFrame:
    """Rows of _ANCHORS whose string occurs at least twice; ``sym`` is null at a text's last anchor."""
    hashes = texts.select(F.explode("hashes").alias("h"))
    hot = keep(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "suffix-hot")
    shared = texts.sparkSession.sparkContext.broadcast(bit_filter(hot, "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for tid, n_bytes, *lists in zip(*(batch.column(k) for k in range(5))):
                h, steps, backs = (np.asarray(x.values) for x in lists)
                place = np.cumsum(steps.astype(np.int64))
                start = place - backs
                kept = np.nonzero(passes(bits, h))[0]
                step = np.diff(place, append=n_bytes.as_py())
                last = np.append(start[1:], n_bytes.as_py() - STRING + 1) - 1
                u = h.view(np.uint64)
                sym = mixed(mixed(u + mixed(step.astype(np.uint64))) + np.append(u[1:], np.uint64(0))).view(np.int64)
                null = kept == len(h) - 1
                columns = [pa.array(np.full(len(kept), tid.as_py())), *(pa.array(c[kept]) for c in (np.arange(len(h)), h, place, start, last, step)), pa.array(sym[kept], mask=null)]
                yield pa.RecordBatch.from_arrays(columns, ["tid", "at", "h", "place", "start", "last", "step", "sym"])

    passing = texts.select("tid", "n_bytes", "hashes", "steps", "backs").mapInArrow(run, _ANCHORS)
    return passing.join(hot, "h", "left_semi")


def numbered(rows: DataFrame, key: list[str], out: str, keep: Keep = cut) -> DataFrame:
    """``rows`` with their place from 1 on in the sort on ``key``, which is unique: sorted ranges, and the sizes of the ranges before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = np.arange(seen + 1, seen + 1 + batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(place)], [*batch.schema.names, "part", out])

    schema = ranged.select("*", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias(out)).schema
    sorted_rows = keep(ranged.mapInArrow(run, schema), "suffix-names")
    sizes = dict(sorted(map(tuple, sorted_rows.groupBy("part").count().collect())))
    before = np.concatenate(([0], np.cumsum(list(sizes.values()))))[:-1].tolist()
    offset = F.element_at(F.create_map(*[F.lit(v) for pair in zip(sizes, before) for v in pair]), F.col("part")) if sizes else F.lit(0)
    return sorted_rows.withColumn(out, F.col(out) + offset).drop("part")


def _following(string: DataFrame) -> DataFrame:
    """A string of (tid, at, sym, step, first) with what follows each place, null where the run ends."""
    w = Window.partitionBy("tid").orderBy("at")
    out = string.withColumns({f"{c}{k}": F.when(F.lead("at", k).over(w) == F.col("at") + k, F.lead(c, k).over(w)) for k in (1, 2) for c in ("sym", "step")})
    return out.withColumn("step2", F.when(F.col("sym1").isNotNull(), F.col("step2"))).withColumn("sym2", F.when(F.col("sym1").isNotNull(), F.col("sym2")))


def _repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs at least twice; counts are partial before they travel."""
    again = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(again, key, "left_semi")


def repeated_suffixes(string: DataFrame, level: int = 0, keep: Keep = cut) -> DataFrame:
    """``(tid, at)`` of places from which symbols of at least SPAN - 2 bytes beyond the first one repeat elsewhere, in a string
    of ``(tid, at, sym, step, first)``: step is a symbol's bytes, first those of its first symbol on the lowest level. Sound, and complete but
    for matches that end within a triple."""
    rest = SPAN - 2
    follow = _following(string).withColumn("triple", F.when(F.col("sym2").isNotNull(), F.xxhash64("sym", "sym1", "sym2"))).drop("sym2")
    follow = keep(follow, "suffix-string")
    sampled = follow.where("at % 3 <> 0 and triple is not null")
    names = numbered(sampled.groupBy("triple").agg(F.count("*").alias("n")).where("n > 1").drop("n"), ["triple"], "name", keep)
    named = keep(sampled.join(names, "triple").select("tid", "at", "name", (F.col("step") + F.col("step1") + F.col("step2")).alias("size"), "first"), "suffix-named")
    long = F.col("size") - F.col("first") >= rest
    found = named.where(long).select("tid", "at")
    if level < MAX_LEVELS and not named.where(~long).isEmpty():
        # the names whose triples are short, and those that follow them
        low = lambda k: F.struct(F.col("tid"), (F.col("at") + k).alias("at"))
        wanted = named.where(~long).select(F.explode(F.array(low(0), low(3), low(6))).alias("p")).select("p.*").distinct()
        deeper = named.join(wanted, ["tid", "at"], "left_semi")
        deeper = deeper.select((2 * F.col("tid") + F.col("at") % 3 - 1).alias("tid"), F.floor(F.col("at") / 3).alias("at"), F.col("name").alias("sym"), F.col("size").alias("step"), "first")
        again = repeated_suffixes(deeper, level + 1, keep)
        found = found.unionByName(again.select(F.shiftright("tid", 1).alias("tid"), (3 * F.col("at") + F.pmod("tid", F.lit(2)) + 1).alias("at")))
    # places that are not sampled, against those that are, by what comes before the next name they share
    next_name = lambda k: named.select("tid", (F.col("at") - k).alias("at"), F.col("name").alias("next"), "size")
    near = follow.where("at % 3 <> 2 and sym1 is not null").join(next_name(1), ["tid", "at"]).where(F.col("size") >= rest)
    far = follow.where("at % 3 <> 1 and sym1 is not null").join(next_name(2), ["tid", "at"]).where(F.col("size") + F.col("step1") >= rest)
    found = found.unionByName(_repeated(near.select("tid", "at", F.xxhash64("sym", "next").alias("key")), ["key"]).select("tid", "at"))
    found = found.unionByName(_repeated(far.select("tid", "at", F.xxhash64("sym", "sym1", "next").alias("key")), ["key"]).select("tid", "at"))
    return found.distinct()


def _per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts of rows sorted by their first column."""
    carry = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if carry is None else [carry, batch]).combine_chunks()
        tid = table.column(0).to_numpy()
        if not len(tid):
            continue
        last = int(np.searchsorted(tid, tid[-1]))
        if last:
            yield table.slice(0, last).to_batches()[0]
        carry = table.slice(last).combine_chunks().to_batches()[0]
    if carry is not None:
        yield carry


def settled(hot: DataFrame, inner: DataFrame) -> DataFrame:
    """``(tid, h, place, start, last, open, from, to)``: whether an anchor has windows that no inner anchor settles, and the bytes that an inner one removes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _per_text(batches):
            tid, h, place, start, last, step = (batch.column(k).to_numpy() for k in range(6))
            is_inner = np.asarray(batch.column(6).to_pylist(), bool)
            covered = np.where(is_inner, step, 0)
            before = np.concatenate(([0], np.cumsum(covered)[:-1]))
            text = np.searchsorted(tid, tid)  # first row of each row's text

            def upto(x: np.ndarray) -> np.ndarray:
                """Settled windows before x, over all rows before it."""
                k = np.arange(len(x))
                while ((move := (k > text) & (place[k] > x))).any():
                    k = k - move
                inside = np.clip(x - place[k], 0, step[k]) * is_inner[k]
                return before[k] + inside

            is_open = upto(last + 1) - upto(start) < last + 1 - start
            to = pa.array(place + step + STRING - 1, mask=~is_inner)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(is_open), pa.array(place, mask=~is_inner), to], ["tid", "h", "place", "start", "last", "open", "from", "to"])

    rows = hot.join(inner.withColumn("inner", F.lit(True)), ["tid", "at"], "left").select("tid", "h", "place", "start", "last", "step", F.coalesce("inner", F.lit(False)).alias("inner"), "at")
    rows = rows.repartition("tid").sortWithinPartitions("tid", "at").drop("at")
    return rows.mapInArrow(run, "tid long, h long, place long, start long, last long, open boolean, from long, to long")


def _passing(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``rows`` (text_key, text) whose key is among the ``wanted`` ones, and few others."""
    shared = rows.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.xxhash64("text_key").alias("k")), "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["text_key", "text"]).filter(pa.array(passes(shared.value, batch.column(2).to_numpy())))

    return rows.withColumn("k", F.xxhash64("text_key")).mapInArrow(run, "text_key binary, text string")


def contexts(keyed: DataFrame, members: DataFrame, texts: DataFrame, keep: Keep = cut) -> DataFrame:
    """``(h, c, tid, place, start, open, n, starts, size, bytes)``: a row for each text and distinct context in it, the bytes under the windows of each anchor
    in ``members``; c is their digest, n how often the text has it, starts where open ones start, place, start and open those of the first. Bytes are null where the task has
    sent them before; a context that occurs once has them."""
    lists = members.groupBy("tid").agg(F.collect_list(F.struct("h", "place", "start", "last", "open")).alias("anchors"))
    lists = keep(lists.join(texts.select("tid", "text_key"), "tid"), "suffix-lists")
    some = _passing(keyed.where(F.octet_length("text") >= STRING).select("text_key", "text"), lists)
    once = some.groupBy("text_key").agg(F.first("text").alias("text"))
    schema = "h long, c binary, tid long, place long, start long, open boolean, n long, starts array<bigint>, size long, bytes binary"
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for tid, found, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw, fields = text.as_py().encode("utf-8", "surrogatepass"), found.values
                rows: dict[tuple[int, bytes], list] = {}
                for h, place, start, last, is_open in zip(*(fields.field(k).to_pylist() for k in range(5))):
                    part = raw[start : last + STRING]
                    row = rows.setdefault((place - start, part), [h, None, tid, place, start, is_open, 0, [], len(part), None])
                    row[6] += 1
                    if is_open:
                        row[7].append(start)
                for (back, part), row in rows.items():
                    row[1] = hashlib.blake2b(bytes([back]) + part, digest_size=16).digest()
                    if row[1] not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(row[1])
                        row[-1] = part
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows.values()), types)], names)

    return lists.join(once, "text_key").select("tid", "anchors", "text").mapInArrow(run, schema)


def _digests(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """For each window of a batch of contexts: its row, its start, and two hashes of anchor, distance and bytes."""
    h, place, start = (batch.column(k).to_numpy() for k in (0, 2, 3))
    sizes = np.fromiter((len(b) for b in batch.column(5).to_pylist()), np.int64, batch.num_rows)
    data = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8)
    row = np.repeat(np.arange(batch.num_rows), sizes - STRING + 1)
    n = sizes - STRING + 1
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(sizes) - sizes, n) + inside
    window = start[row] + inside
    salt = mixed(h.view(np.uint64)[row] + (place[row] - window).astype(np.uint64))
    return row, window, *(mixed(string_hashes(data, STRING, which)[at] + salt) for which in (0, 1))


def _spans(tid: np.ndarray, window: np.ndarray) -> pa.RecordBatch:
    """Runs of windows in a row, as bytes."""
    order = np.lexsort((window, tid))
    tid, window = tid[order], window[order]
    heads = np.nonzero(np.append(True, (tid[1:] != tid[:-1]) | (window[1:] > window[:-1] + 1)))[0] if len(tid) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(tid)) - 1 if len(heads) else heads
    return pa.RecordBatch.from_arrays([pa.array(tid[heads]), pa.array(window[heads]), pa.array(window[ends] + STRING)], ["tid", "from", "to"])


def edge_spans(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``(tid, from, to)``: bytes under open windows that equal another window, from the contexts of all anchors they could equal."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _per_text(batches):
            row, window, a, b = _digests(batch)
            order = np.lexsort((b, a))
            same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
            again = np.zeros(len(row), bool)
            again[order] = np.append(False, same) | np.append(same, False)
            again &= np.asarray(batch.column(4).to_pylist(), bool)[row]
            yield _spans(batch.column(1).to_numpy()[row[again]], window[again])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, window, a, b = _digests(batch)
            columns = [a.view(np.int64), b.view(np.int64), batch.column(1).to_numpy()[row], window, np.asarray(batch.column(4).to_pylist(), bool)[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "tid", "from", "open"])

    names = ["h", "tid", "place", "start", "open", "bytes"]
    sent = rows.where("bytes is not null")
    few = sent.join(large, "h", "left_anti").select(*names).repartition("h").sortWithinPartitions("h")
    many = sent.join(large, "h", "left_semi").dropDuplicates(["c"]).select(*names).mapInArrow(spread, "a long, b long, tid long, from long, open boolean")
    met = _repeated(many, ["a", "b"]).where("open").select("tid", "from", (F.col("from") + STRING).alias("to"))
    # equal contexts: all their windows are repeated
    again = rows.groupBy("c").agg(F.sum("n").alias("all")).where("all > 1").drop("all")
    whole = rows.where(F.size("starts") > 0).join(again, "c", "left_semi").select("tid", F.explode("starts").alias("from"), "size")
    whole = whole.select("tid", "from", (F.col("from") + F.col("size")).alias("to"))
    return few.mapInArrow(meet, "tid long, from long, to long").unionByName(met).unionByName(whole)


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """``(text_key, spans)``: the byte ranges (start, end; they may overlap) that each text loses."""
    tables: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        """A written table that goes when the spans are written."""
        tables.append(cut(df, name))
        return tables[-1]

    texts = keep(anchored_texts(keyed), "suffix-texts")
    hot = keep(hot_anchors(texts, keep), "suffix-anchors")
    inner = repeated_suffixes(hot.where("sym is not null").select("tid", "at", "sym", "step", F.col("step").alias("first")), keep=keep)
    rows = keep(settled(hot, inner), "suffix-settled")
    open_strings = rows.where("open").select("h").distinct()
    members = rows.join(open_strings, "h", "left_semi")
    around = keep(contexts(keyed, members, texts, keep), "suffix-contexts")
    large = keep(around.where("bytes is not null").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("h"), "suffix-large")
    edges = edge_spans(around, large)
    spans = edges.unionByName(rows.where("from is not null").select("tid", "from", "to")).unionByName(texts.where("copies > 1").select("tid", F.lit(0).cast("long").alias("from"), F.col("n_bytes").alias("to")))
    lists = spans.groupBy("tid").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    out = cut(lists.join(texts.select("tid", "text_key"), "tid").select("text_key", "spans"), "suffix-spans")
    discard(*tables)
    return out


def _kept(raw: bytes, spans: pa.StructScalar) -> tuple[bytes, int, int]:
    """What stays of a text, bytes removed, and maximal runs of them."""
    if not spans.is_valid:
        return raw, 0, 0
    both = np.stack([spans.values.field(k).to_numpy() for k in range(2)], axis=1)
    start, end = both[np.lexsort((both[:, 1], both[:, 0]))].T
    reach = np.maximum.accumulate(end)
    heads = np.nonzero(np.append(True, start[1:] > reach[:-1]))[0]
    runs = list(zip(start[heads].tolist(), np.append(reach[heads[1:] - 1], reach[-1]).tolist()))
    parts, at = [], 0
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    kept = b"".join([*parts, raw[at:]])
    return kept, len(raw) - len(kept), len(runs)


def suffix_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs``."""
    keyed, names = _keyed(docs), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    spans = repeated_spans(keyed)
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(spans.select(F.xxhash64("text_key").alias("k")), "k"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a text without spans comes to; the texts that may have some go on."""
        for batch in batches:
            rows = []
            for text, some in zip(batch.column(2), passes(shared.value, batch.column(3).to_numpy())):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                rows.append((len(raw), None, text.as_py()) if some else (len(raw), hashlib.sha256(raw).hexdigest(), None))
            size, sha, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], ["doc_id", "text_key", "n_bytes", "sha", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, n, sha = [], [], []
            for known, text, found in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                kept, removed, runs = _kept(text.as_py().encode("utf-8", "surrogatepass"), found) if known is None else (b"", 0, 0)
                gone.append(removed)
                n.append(runs)
                sha.append(known or hashlib.sha256(kept).hexdigest())
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (gone, n)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = keyed.select("doc_id", "text_key", "text", F.xxhash64("text_key").alias("k")).mapInArrow(whole, "doc_id long, text_key binary, n_bytes long, sha string, text string")
    rows = rows.join(spans, "text_key", "left").select("doc_id", "n_bytes", "sha", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
