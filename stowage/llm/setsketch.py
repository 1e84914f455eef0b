"""Near duplicates by SetSketch registers.

A register is the truncated, exponentially spaced minimum of one hash over a
document's shingles, so registers of unions are maxima of registers, and equal
registers become likelier the more two sets share. Documents with equal sets
collapse into one class first. Bands of registers propose pairs of classes; the
joint likelihood of all registers drops pairs far from the threshold; the others
are confirmed on their full shingle sets. Confirmed links give components.

Groups never turn into all their pairs. Shingles that no other candidate has
bound how much a document can share with any other: documents with too many of
them leave, and pairs that cannot reach the threshold are never made. A bucket
links its members to its least singular one first; components merge, and buckets
within one component are finished. Members of what is left apart meet again by
their rarest shingles, of which two sets that link share one near the front, and
are paired across components only where what follows it can reach the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import WordHashes, batches, mix, ngram_hashes, odd_numbers, settle, texts
from stowage.operators.skew import attach

#: Words per shingle; pairs link from SHARED percent of their union on.
SHINGLE, SHARED = 5, 85
#: Registers of a band, and the chance with which a pair at the threshold may share no band.
ROWS, MISS = 5, 4.3e-7
#: Base and rate of the registers' exponential spacing.
BASE, RATE = 1.001, 20.0
#: Pairs are dropped if their likeliest similarity is below this, 7 deviations under the threshold.
DOUBT = 0.6
_CHUNK = 2048


def bands(shared: int) -> int:
    """Bands with which a pair at the threshold is missed with a chance of at most MISS: 25 at 85, 37 at 80."""
    return math.ceil(math.log(MISS) / math.log1p(-((shared / 100) ** ROWS))) if shared < 100 else 1


#: Registers at the operator's own threshold.
REGISTERS = bands(SHARED) * ROWS


def registers(hashes: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (16 bits) of a set of 64-bit hashes."""
    factors, shifts = odd_numbers(count, 41), odd_numbers(count, 42)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), _CHUNK):
        part = hashes[a : a + _CHUNK, None] * factors
        part += shifts
        np.minimum(least, part.min(0), out=least)
    spaced = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(spaced, 1e-300)) / np.log(BASE)), 0, 65535).astype("<u2")


def shingles(text: str, known: WordHashes) -> np.ndarray:
    """Distinct hashes of the text's word shingles, ascending."""
    # bytes.lower and bytes.split treat A-Z and the six separators alone.
    words = known.of(text.encode("utf-8", "surrogatepass").lower().split())
    return np.unique(ngram_hashes(words, SHINGLE))


def _sketch(count: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches(it):
        n, keys, regs = [], [], []
        for t in texts(batch):
            s = shingles(t, known)
            n.append(len(s))
            if len(s):
                both = [int(mix(s ^ np.uint64(k)).sum(dtype=np.uint64)) for k in (1, 2)]
                keys.append(both[0].to_bytes(8, "little") + both[1].to_bytes(8, "little"))
                regs.append(registers(s, count).tobytes())
            else:
                keys.append(None)
                regs.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())],
            names=["doc_id", "n", "key", "regs"],
        )


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches(it):
        sets = [shingles(t, known).view(np.int64) for t in texts(batch)]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), column], names=["rep", "hashes"])


def likeliest(plus: np.ndarray, minus: np.ndarray, na: np.ndarray, nb: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """Similarity of greatest likelihood, given how many registers are greater and less, and the set sizes."""
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for step in np.linspace(0, 1, 101):
        j = step * most
        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        same = np.maximum(1 - up - down, 1e-12)
        value = plus * np.log(up) + minus * np.log(down) + (count - plus - minus) * np.log(same)
        better = value > best
        best[better], at[better] = value[better], j[better]
    return at


def _likely(doubt: float, count: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, count) for c in ("regs_a", "regs_b"))
        na, nb = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
        j = likeliest((a > b).sum(1), (a < b).sum(1), na, nb, count)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(j >= doubt))


def confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, shared: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets reach the threshold."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    # Sets of too different sizes cannot share enough.
    met = met.filter(100 * F.least("n_a", "n_b") >= shared * F.greatest("n_a", "n_b"))
    likely = met.mapInArrow(partial(_likely, DOUBT * shared / SHARED, bands(shared) * ROWS), "a long, b long")
    full = lambda x: sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"set_{x}"))
    both = likely.join(full("a"), "a").join(full("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.filter(100 * common >= shared * union).select("a", "b")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, comp) of every node in ``links`` (a, b): comp is the least node it reaches.

    Each round a node takes the least label among its neighbours', then the
    label of that label. Labels are written to shared storage every round.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), f"{label}-edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), label)
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("comp").alias("near"))
        least = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = labels.join(least, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        jumped = hooked.join(up, "comp", "left").select("node", "old", F.least("comp", F.coalesce("above", "comp")).alias("comp"))
        nxt = settle(jumped, label)
        labels = nxt.select("node", "comp")
        if nxt.filter("old <> comp").isEmpty():
            return labels


def _possible(a: str, b: str, shared: int) -> Column:
    """Whether two sets can reach the threshold, by what each has that no other candidate has.

    At most ``m`` shingles are common, the smaller of what the two have in
    common with anyone; with fewer the union is larger.
    """
    m = F.least(F.col(f"n_{a}") - F.col(f"own_{a}"), F.col(f"n_{b}") - F.col(f"own_{b}"))
    return 100 * m >= shared * (F.col(f"n_{a}") + F.col(f"n_{b}") - m)


def _star(members: DataFrame, shared: int) -> DataFrame:
    """Candidate pairs: every member of a bucket with its least singular one."""
    me = F.struct("rep", "n_x", "own_x", "comp")
    leaders = members.groupBy("h").agg(F.min_by(me, F.struct(F.col("own_x") / F.col("n_x"), "rep")).alias("l"))
    met = members.join(leaders, "h").filter("comp <> l.comp").select(
        F.col("rep").alias("x"), "n_x", "own_x", F.col("l.rep").alias("y"), F.col("l.n_x").alias("n_y"), F.col("l.own_x").alias("own_y")
    )
    return _ordered(met.filter(_possible("x", "y", shared)))


def _cross(members: DataFrame, shared: int) -> DataFrame:
    """Candidate pairs: members of a bucket that lie in different components."""
    other = members.select(
        "h", F.col("rep").alias("y"), F.col("n_x").alias("n_y"), F.col("own_x").alias("own_y"), F.col("comp").alias("comp_y")
    )
    met = members.join(other, (members["h"] == other["h"]) & (F.col("comp") < F.col("comp_y")) & _possible("x", "y", shared))
    return _ordered(met.select(F.col("rep").alias("x"), "y"))


def _by_rarest(members: DataFrame, sets: DataFrame, shared: int) -> DataFrame:
    """The same members in buckets of their rarest shingles; own_x counts the shingles before.

    With shingles ordered by how many members hold them, two sets that link have
    their first common shingle among the first ``n - ceil(shared / 100 * n) + 1``
    of each, and nothing before it in common.
    """
    reps = members.select("rep", "n_x", "comp").distinct()
    held = sets.join(reps.select("rep"), "rep").select("rep", F.explode("hashes").alias("s"))
    often = held.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1")
    counted = attach(held, often, ["s"], ["rep"], weight="c")
    ordered = counted.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "s"))).alias("l"))
    n = F.size("l")
    front = F.slice("l", F.lit(1), (n - F.ceil(n * shared / 100) + 1).cast("int"))
    first = ordered.select("rep", F.posexplode(front).alias("at", "x")).filter("x.c > 1")
    return first.join(reps, "rep").select(F.col("x.s").alias("h"), "rep", "n_x", F.col("at").cast("bigint").alias("own_x"), "comp")


def _apart(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component."""
    split = members.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("h")
    return settle(members.join(split, "h", "left_semi"), "buckets")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _renamed(base: DataFrame) -> DataFrame | None:
    """(doc_id, text, own_id): rows with an id for each, the first two columns as given; None where every id has one text.

    Only ids that several different texts bear get new ids, below all others.
    """
    texts = base.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi")
    )
    many = settle(texts.filter("lo <> hi").select("doc_id"), "repeated-ids")
    if many.isEmpty():
        return None
    least = base.agg(F.min("doc_id")).first()[0]
    rows = settle(base.join(many, "doc_id", "left_semi"), "repeated-rows")
    # The table is written, so a row keeps its number.
    numbered = settle(rows.withColumn("own_id", F.lit(least) - 1 - F.monotonically_increasing_id()), "renamed")
    return base.join(many, "doc_id", "left_anti").withColumn("own_id", F.col("doc_id")).unionByName(numbered)


def near_duplicates(docs: DataFrame, shared: int = SHARED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Words are lower-cased (A-Z) runs between the six separators. Two documents
    link if ``100 * intersection >= shared * union`` of their distinct 5-word
    shingles; a text of fewer words is one shingle, one without words (null,
    empty) links with nothing and keeps itself. component_id is the smallest
    doc_id reachable. Rows that repeat an id are judged each by its own text,
    and each counts for what links with it. A null id links with nothing and is
    kept.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _renamed(base)
    if rows is None:
        return _near_duplicates(base, shared)
    rows = settle(rows, "rows")
    found = settle(_near_duplicates(rows.select(F.col("own_id").alias("doc_id"), "text"), shared), "found")
    ids = rows.filter("own_id IS NOT NULL").select("own_id", F.col("doc_id").alias("_id")).distinct()
    known = found.join(ids, F.col("doc_id") == F.col("own_id")).select("_id", "n_shingles", "component_id")
    least = known.groupBy("component_id").agg(F.min("_id").alias("_least"))
    out = attach(known, least, ["component_id"], ["_id"]).select(
        F.col("_id").alias("doc_id"), "n_shingles", F.col("_least").alias("component_id"), (F.col("_id") == F.col("_least")).alias("kept")
    )
    return out.unionByName(found.filter("doc_id IS NULL"))


def _near_duplicates(base: DataFrame, shared: int) -> DataFrame:
    """The same for rows whose every id stands for one text."""
    sketched = settle(base.mapInArrow(partial(_sketch, bands(shared) * ROWS), "doc_id long, n long, key binary, regs binary"), "sketches")
    linked = sketched.filter("doc_id IS NOT NULL AND key IS NOT NULL")
    classes = linked.groupBy("key").agg(F.min(F.struct("doc_id", "n", "regs")).alias("c"))
    reps = settle(classes.select("key", F.col("c.doc_id").alias("rep"), "c.n", "c.regs"), "classes")
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 1 + i * width, width)) for i in range(bands(shared))])
    banded = reps.select("rep", F.explode(keys).alias("h"))
    crowded = banded.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    crowd = settle(banded.join(crowded, "h").select("h", "rep"), "buckets")
    near = crowd.select("rep").distinct()
    sets = settle(
        base.join(near, F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(_sets, "rep long, hashes array<bigint>")
        .dropDuplicates(["rep"]),
        "shingle-sets",
    )
    # Shingles that no other candidate has; a set with too many of them links with nothing.
    own = (
        sets.select("rep", F.explode("hashes").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("rep").alias("rep"))
        .filter("c = 1").groupBy("rep").agg(F.count("*").alias("own"))
    )
    near_reps = settle(
        reps.join(near, "rep", "left_semi").join(own, "rep", "left")
        .select("rep", "n", "regs", F.coalesce("own", F.lit(0).cast("bigint")).alias("own"))
        .filter(100 * (F.col("n") - F.col("own")) >= shared * F.col("n")).dropDuplicates(["rep"]),
        "near-classes",
    )
    known = near_reps.select("rep", F.col("n").alias("n_x"), F.col("own").alias("own_x"))
    members = _apart(crowd.join(known, "rep").withColumn("comp", F.col("rep")))
    comps = None
    if not members.isEmpty():
        tested = settle(_star(members, shared), "pairs")
        links = settle(confirmed(tested, near_reps, sets, shared), "links")
        comps = components(links)
        named = members.drop("comp").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        members = _apart(named.withColumn("comp", F.coalesce("comp", "rep")))
        rest = _cross(_apart(_by_rarest(members, sets, shared)), shared).join(tested, ["a", "b"], "left_anti")
        more = settle(confirmed(rest, near_reps, sets, shared), "links")
        if not more.isEmpty():
            comps = components(links.union(more))
    out = sketched.join(reps.select(F.col("key").alias("_key"), "rep"), F.col("key") == F.col("_key"), "left")
    if comps is not None:
        out = out.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    else:
        out = out.withColumn("comp", F.lit(None).cast("long"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
