"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the multiset of its five-word shingles. ProbMinHash gives each
shingle a Poisson process of arrivals at the rate of its weight; every arrival
falls on a random register, a register keeps its earliest shingle, and a
shingle stops as soon as its next arrival is later than all registers. Two
documents agree in a register with the probability Jaccard similarity of
their weights. Bands of registers give buckets; inside a bucket, documents
are compared with leaders, never all with all, and every candidate pair is
verified on the shingles of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import arrowtext as A
from tessera.llm.components import connected_components
from tessera.llm.tables import body, lookup_join
from tessera.session import cut_lineage, ship_package

# Production parameters.
SHINGLE = 5
SIMILARITY = 0.8
#: Room for rounding: a similarity is a sum of quotients, so one that equals the threshold may come out a little below it.
ROUNDING = 1e-9
BANDS = 40
BAND_ROWS = 8
#: Leaders that a bucket sends in a round after the first, from outside its largest class, and rows compared with them in one group.
LEADERS = 256
CHUNK_ROWS = 1024
#: 8-bit registers of the longer sketch that documents of open buckets are compared by.
SKETCH = 2048
#: Standard deviations below the threshold at which a pair's share of equal sketch registers still gets it verified.
SLACK = 4.0
SALTS = 32

_ARRIVAL = 0xA0761D6478BD642F


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, code and count of each distinct shingle, by text. A text of fewer words is one shingle; none without words."""
    data, starts = A.joined(texts)
    at, _, codes = A.words(data, A.ALNUM)
    first = A.by_text(at, starts)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n_words)
    runs = A.run_codes(codes, size)
    whole = np.flatnonzero(owner[:len(runs)] == owner[size - 1:]) if len(runs) else np.zeros(0, np.int64)
    code, text = runs[whole], owner[whole]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        code = np.concatenate([code, np.array([A.run_codes(codes[first[k]:first[k + 1]], int(n_words[k]))[0] for k in short], np.uint64)])
        text = np.concatenate([text, short])
    key = A.mix64(code ^ A.mix64(text.astype(np.uint64) + np.uint64(1)))
    _, index, count = np.unique(key, return_index=True, return_counts=True)
    by = np.argsort(index, kind="stable")
    index, count = index[by], count[by]
    by = np.argsort(text[index], kind="stable")
    return text[index][by], code[index][by], count[by]


def signatures(text: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash registers (the code of the earliest shingle) of ``n`` texts; zeros for a text without shingles."""
    earliest = np.full(n * registers, np.inf)
    holder = np.zeros(n * registers, np.uint64)
    time, step, check = np.zeros(len(code)), 0, 0
    while len(code):
        draw = A.mix64(code + np.uint64((step + 1) * _ARRIVAL % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(32)).astype(np.float64) + 0.5) / 2.0 ** 32) / weight
        register = text * registers + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
        sooner = np.flatnonzero(time < earliest[register])
        np.minimum.at(earliest, register[sooner], time[sooner])
        won = sooner[earliest[register[sooner]] == time[sooner]]
        holder[register[won]] = code[won]
        step += 1
        if step > check:  # arrivals later than all registers change nothing, so shingles may stop some steps late
            open_texts, of = np.unique(text, return_inverse=True)
            alive = time < earliest.reshape(n, registers)[open_texts].max(axis=1)[of]
            text, code, weight, time = text[alive], code[alive], weight[alive], time[alive]
            check = step + step // 16
    return holder.reshape(n, registers)


def band_codes(holder: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit code for each band of each signature; equal bands of different numbers differ."""
    parts = holder.reshape(len(holder), bands, rows)
    out = np.broadcast_to(A.mix64(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(rows):
        out = A.mix64(out * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return out.view(np.int64)


def sketch_bytes(holder: np.ndarray) -> np.ndarray:
    """8 bits of each register."""
    return (A.mix64(holder.ravel()) >> np.uint64(56)).astype(np.uint8).reshape(holder.shape)


def _pieces(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[k], first[k] + 1, ... (count[k] of them) for every k, end to end."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def pair_similarities(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Probability Jaccard similarity of each pair of texts on whole shingle counts: the sum over shared shingles d
    of 1 / sum_e max(a_e / a_d, b_e / b_d); 0 if a text has no words.

    With the shingles of a pair sorted by a_e / b_e, the maxima are the
    weights of a from d on and those of b, scaled, before d.
    """
    sides = []
    for texts in (left, right):
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(t, len(number)) for t in texts])
        owner, code, count = shingles(list(number))
        edge = np.searchsorted(owner, np.arange(len(number) + 1))
        sizes = np.diff(edge)[which]
        take = _pieces(edge[:-1][which], sizes)
        sides.append((np.repeat(np.arange(len(texts)), sizes), code[take], count[take].astype(np.float64)))
    pair, code = np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides])
    key, index, where = np.unique(A.mix64(code ^ A.mix64(pair.astype(np.uint64) + np.uint64(1))), return_index=True, return_inverse=True)
    cut = len(sides[0][0])
    x, y = np.bincount(where[:cut], sides[0][2], len(key)), np.bincount(where[cut:], sides[1][2], len(key))
    pair = pair[index]
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    by = np.lexsort((ratio, pair))
    x, y, ratio, pair = x[by], y[by], ratio[by], pair[by]
    edge = np.searchsorted(pair, np.arange(len(left) + 1))
    sum_x, sum_y = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(y)))
    shared = np.flatnonzero((x > 0) & (y > 0))
    of = pair[shared]
    above = sum_x[edge[of + 1]] - sum_x[shared]
    below = sum_y[shared] - sum_y[edge[of]]
    return np.bincount(of, x[shared] / (above + ratio[shared] * below), len(left))


def digest(text: str) -> Column:
    """A key of the text itself; null is an empty text."""
    return F.unhex(F.md5(body(text)))


def signed(docs: DataFrame, key: str, text: str, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(id, copy_of, bands): a digest of the text and its band codes (none without words)."""
    ship_package(docs.sparkSession)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in A.slices(batches):
            texts = A.bodies(part)
            owner, code, count = shingles(texts)
            codes = band_codes(signatures(owner, code, count.astype(np.float64), len(texts), bands * rows), bands, rows)
            some = np.zeros(len(texts), bool)
            some[owner] = True
            offsets = np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes[some].ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copy_of"), lists], ["id", "copy_of", "bands"])

    raw = body(text)
    src = docs.select(F.col(key).cast("long").alias("id"), digest(text).alias("copy_of"), raw.alias("body"))
    return src.mapInArrow(sign, "id long, copy_of binary, bands array<bigint>")


def sketched(texts: DataFrame, registers: int = SKETCH) -> DataFrame:
    """(id, sketch) of texts (id, body): 8 bits of each register of a longer signature."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in A.slices(batches):
            bodies = A.bodies(part)
            owner, code, count = shingles(bodies)
            packed = sketch_bytes(signatures(owner, code, count.astype(np.float64), len(bodies), registers))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.tobytes() for x in packed], pa.binary())], ["id", "sketch"])

    return texts.select("id", "body").mapInArrow(sketch, "id long, sketch binary")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with the probability Jaccard similarity of their whole texts."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in A.slices(batches, "body_a", "body_b"):
            found = pair_similarities(A.bodies(part, "body_a"), A.bodies(part, "body_b"))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    # the texts of b move once, keyed by a; a leader's text is met there, not copied through a shuffle
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")
    return both.select("a", "b", "body_a", "body_b").mapInArrow(compare, "a long, b long, similarity double")


def led_pairs(rows: DataFrame, lead: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a leader and a document of another class in its bucket that may be linked.

    ``rows``: bucket, id, far, class; ``lead``: the same for leaders;
    ``sketches``: id, sketch. Buckets are cut in chunks of about
    ``CHUNK_ROWS`` and meet all leaders of the bucket. Left out are pairs
    whose distances to the bucket's smallest id differ by more than a link
    allows, and pairs whose sketches agree far too rarely.
    """
    reach = 1.0 - similarity + ROUNDING

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        number = lambda t, c: t.column(c).to_numpy()
        signs = lambda t, c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(t.num_rows, -1)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            ids, far, kind, own = number(left, "id"), number(left, "far"), number(left, "class"), signs(left, "sketch")
            width = own.shape[1]
            # unequal registers may share their 8 bits by chance, but a pair of few shingles need not have any that do
            floor = width * similarity - SLACK * np.sqrt(width * similarity * (1.0 - similarity))
            for a, far_a, kind_a, sign in zip(number(right, "lead_id"), number(right, "lead_far"), number(right, "lead_class"),
                                               signs(right, "lead_sketch")):
                some = np.flatnonzero((kind != kind_a) & (np.abs(far - far_a) <= reach))
                some = some[(own[some] == sign).sum(axis=1, dtype=np.int64) >= floor]
                found.append((np.minimum(ids[some], a), np.maximum(ids[some], a)))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *[x[0] for x in found]]), "b": np.concatenate([none, *[x[1] for x in found]])})

    chunks = rows.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    left = (rows.join(sketches, "id").join(lead.select("bucket").distinct().join(chunks, "bucket"), "bucket")
            .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")))
    right = lead.join(sketches, "id").join(chunks, "bucket").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    fields = ["bucket", "chunk", "id", "far", "class", "sketch"]
    right = right.select(*[F.col(f).alias(f"lead_{f}") for f in fields])
    groups = left.select(*fields).groupBy("bucket", "chunk").cogroup(right.groupBy("lead_bucket", "lead_chunk"))
    return groups.applyInArrow(compare, "a long, b long").distinct()


def numbered(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``reps`` (copy_of, rep, ...) with ``node``, a number of its own for each text, and the (copy_of, node) that are not ``rep``.

    A text's number is its smallest id ``rep``. Of several texts with the same
    one, the first by digest has it; the others draw numbers until they are
    free.
    """
    shared = cut_lineage(reps.groupBy("rep").count().filter("count > 1").select("rep"), "near-shared")
    if shared.isEmpty():
        return reps.withColumn("node", F.col("rep")), None
    clash = cut_lineage(reps.select("copy_of", "rep").join(shared, "rep"), "near-clash")
    left = clash.join(clash.groupBy("rep").agg(F.min("copy_of").alias("first")), "rep").filter("copy_of <> first").select("copy_of")
    done, taken, turn = None, reps.select(F.col("rep").alias("node")), 0
    while True:
        drawn = cut_lineage(left.select("copy_of", F.xxhash64("copy_of", F.lit(turn)).alias("node")), "near-drawn")
        once = drawn.groupBy("node").count().filter("count = 1").select("node")
        fresh = cut_lineage(drawn.join(once, "node").join(taken, "node", "left_anti").select("copy_of", "node"), "near-numbers")
        done = fresh if done is None else done.unionByName(fresh)
        left = cut_lineage(drawn.join(fresh.select("copy_of"), "copy_of", "left_anti").select("copy_of"), "near-left")
        if left.isEmpty():
            break
        taken, turn = taken.unionByName(fresh.select("node")), turn + 1
    return lookup_join(reps, done.withColumnRenamed("copy_of", "_of"), F.col("copy_of") == F.col("_of"), "left").withColumn(
        "node", F.coalesce("node", "rep")).drop("_of"), done


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                           leaders: int = LEADERS) -> DataFrame:
    """(id, class_id) of ``classed``."""
    return classed(docs, key, text, similarity, leaders).select("id", "class_id")


def classed(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, leaders: int = LEADERS) -> DataFrame:
    """(id, copy_of, class, class_id): class_id is the smallest id among all documents linked to a document, directly or
    through others; copy_of is its text's digest, and class a number that no two classes share.

    Documents are linked by equal texts, or by a verified similarity found in
    a shared bucket. Null is an empty text; texts without words are linked to
    equal texts only. ``key`` is an integer; rows with a null key get a null
    class, and rows of a repeated key are each classed by their own text, so
    that two classes may have the same class_id.

    Round one compares every bucket's smallest id with the others of the
    bucket. Buckets that still hold several classes then send leaders from
    outside their largest class, a bounded number each round, against the
    documents of other classes, until each outsider has led. One minus the
    probability Jaccard similarity is a metric, so a pair is safely left out
    if its distances to the bucket's smallest id differ by more than a link
    allows; others are left out only if their sketches agree ``SLACK``
    standard deviations too rarely for a link. So no two classes of a bucket
    stay apart without the comparisons that could join them.
    """
    spark = docs.sparkSession
    table = cut_lineage(signed(docs, key, text), "near-signed")
    texts_of = table.filter("id is not null").groupBy("copy_of").agg(F.min("id").alias("rep"), F.min("bands").alias("bands"))
    reps, extra = numbered(cut_lineage(texts_of, "near-reps"))
    rows = cut_lineage(reps.filter(F.size("bands") > 0).select(F.explode("bands").alias("bucket"), F.col("node").alias("id")), "near-bands")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("leader")).filter("n > 1")
    held = cut_lineage(rows.join(sizes, "bucket"), "near-buckets")
    wanted = reps.select("node", "rep", "copy_of").join(held.select(F.col("id").alias("node")).distinct(), "node")
    texts = docs.select(F.col(key).cast("long").alias("rep"), digest(text).alias("copy_of"), body(text).alias("body"))
    texts = cut_lineage(texts.join(wanted, ["rep", "copy_of"]).select(F.col("node").alias("id"), "body"), "near-texts")
    pairs = cut_lineage(held.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "near-pairs")
    tested, led = pairs, held.select("bucket", F.col("leader").alias("id")).distinct()
    first = cut_lineage(verify(pairs, texts).groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "near-first")
    links = first.filter(F.col("similarity") >= similarity - ROUNDING).select(F.col("a").alias("u"), F.col("b").alias("v"))
    classes = cut_lineage(connected_components(links), "near-classes")
    # with the distance to the bucket's smallest id
    held = (held.filter("n > 2").join(first.select(F.col("a").alias("leader"), F.col("b").alias("id"), "similarity"), ["leader", "id"], "left")
            .select("bucket", "id", (1.0 - F.coalesce("similarity", F.lit(1.0))).alias("far")))
    sketches = None
    while True:
        now = held.join(classes, "id", "left").select("bucket", "id", "far", F.coalesce("class", "id").alias("class"))
        now = cut_lineage(now, "near-now")
        per_class = now.groupBy("bucket", "class").agg(F.count("*").alias("n"))
        mixed = (per_class.groupBy("bucket").agg(F.count("*").alias("classes"), F.max(F.struct("n", "class")).alias("top"))
                 .filter("classes > 1").select("bucket", F.col("top.class").alias("main")))
        open_rows = cut_lineage(now.join(mixed, "bucket"), "near-open")
        out = open_rows.filter("class <> main").join(led, ["bucket", "id"], "left_anti").select("bucket", "id", "far", "class")
        # a leader's place in its bucket is first bounded in salted parts; the order is the same in all buckets
        order = [F.xxhash64("id"), F.col("id")]
        out = (out.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
               .withColumn("r", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy(*order))).filter(F.col("r") <= leaders)
               .withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).filter(F.col("r") <= leaders))
        lead = cut_lineage(out.select("bucket", "id", "far", "class"), "near-lead")
        if lead.isEmpty():
            break
        if sketches is None:  # later rounds have no other documents
            sketches = cut_lineage(sketched(texts.join(open_rows.select("id").distinct(), "id")).distinct(), "near-sketches")
        led = led.unionByName(lead.select("bucket", "id"))
        fresh = led_pairs(open_rows.select("bucket", "id", "far", "class"), lead, sketches, similarity).join(tested, ["a", "b"], "left_anti")
        pairs = cut_lineage(fresh, "near-pairs")
        tested = tested.unionByName(pairs)
        more = cut_lineage(verify(pairs, texts).filter(F.col("similarity") >= similarity - ROUNDING).select(F.col("a").alias("u"), F.col("b").alias("v")), "near-links")
        if not more.isEmpty():
            links = classes.select(F.col("id").alias("u"), F.col("class").alias("v")).unionByName(more)
            classes = cut_lineage(connected_components(links), "near-classes")
        held = open_rows.select("bucket", "id", "far")
    known = reps.join(classes, reps.node == classes.id, "left").select("copy_of", "rep", F.coalesce("class", "node").alias("class"))
    if extra is None:
        known = known.select("copy_of", "class", F.col("class").alias("class_id"))
    else:  # a class that holds a drawn number is not named by its smallest one
        known = cut_lineage(known, "near-known")
        named = cut_lineage(known.join(extra.select("copy_of"), "copy_of", "left_semi").select("class").distinct(), "near-named")
        least = lookup_join(known, named.withColumnRenamed("class", "_class"), F.col("class") == F.col("_class"), "left_semi")
        least = cut_lineage(least.groupBy(F.col("class").alias("_class")).agg(F.min("rep").alias("least")), "near-least")
        known = lookup_join(known, least, F.col("class") == F.col("_class"), "left").select(
            "copy_of", "class", F.coalesce("least", "class").alias("class_id"))
    own = lambda c: F.when(F.col("id").isNotNull(), F.col(c)).alias(c)
    return table.select("id", "copy_of").join(known, "copy_of", "left").select("id", "copy_of", own("class"), own("class_id"))
