"""Near-duplicate groups from SetSketch registers over word shingles.

A document's set holds its distinct ``k``-word shingles; with fewer words, the
whole sequence is one.  A sketch has ``bands * rows`` registers.  Register i is
``floor(1 - log_base h_i)`` of the smallest ``h_i`` over the set, a minimum of
exponential variables truncated to ``[0, LEVELS]``: sketches of parts merge by
maximum, and two registers agree about as often as the sets' Jaccard similarity.
The exponentials come from one point process for each element, whose points fall
on registers at random, so an element of a large set costs about one step.

Steps: documents with equal sets become one class; bands of registers make
buckets; in a few rounds every class of a bucket meets the bucket's centre, first
one, then others where a bucket isn't in one component yet; a joint likelihood
over the registers discards hopeless pairs; the rest is decided on the full sets.
A large group of near copies so becomes one component from a few pairs for each
member.  Classes that no centre connected though they share a bucket then meet by
the prefix filter of exact similarity joins: two sets that are similar have a common
shingle among their rarest ones.  So a bucket needs no cap and no link in it is lost.  With 30 bands
of 5 a pair at similarity 0.8 shares no bucket with probability below 1e-5.

Defined cases: null and empty texts have no shingles and are linked with nothing;
a component is named by its smallest non-null id; :func:`drop_near_copies` keeps a
row without id only where no row of its component has one; rows that share an id
but not a text are decided each by its own text, rows that share both are answered
alike; columns of other names don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundsmith.llm.common import Cache, discard, mapped, written

BANDS, ROWS = 30, 5
#: Random orders of a bucket's members in each round of centres.
CENTRES = (1, 3)
BASE, RATE, LEVELS = 1.02, 20.0, 2047
#: A class in more than one of so many pairs is dealt over several tasks.
HOT_SHARES = 1000
#: A pair is discarded if its registers are e**-DOUBT times as likely at the threshold as at their best.
DOUBT = 16.0

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased."""
    return text.lower().split() if text else []


def shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    if len(words) <= k:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def similar(a: set, b: set, threshold: float) -> bool:
    """Jaccard similarity of at least ``threshold``, in whole hundredths."""
    both = len(a & b)
    return 100 * both >= round(100 * threshold) * (len(a) + len(b) - both)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_WORDS = Cache(200_000, xxhash.xxh3_64_intdigest)


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    _WORDS.turn()
    hashed = np.array(list(map(_WORDS.__getitem__, words)), np.uint64)
    size = min(k, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        out = _mixed((out * _GOLDEN) ^ hashed[i : i + len(out)])
    return np.unique(out)


def sketches(sets: list[np.ndarray], registers: int = BANDS * ROWS) -> np.ndarray:
    """A row of registers for each set of hashes, as int16; sets mustn't be empty."""
    out = np.zeros((len(sets), registers), np.int16)
    todo, reach = np.arange(len(sets)), math.log(registers) + 4
    while len(todo):
        held = [sets[i] for i in todo]
        sizes = np.array([len(s) for s in held])
        limit = reach / sizes
        best = np.full(len(held) * registers, np.inf)
        element = np.concatenate(held)
        owner = np.repeat(np.arange(len(held)), sizes)
        time = np.zeros(len(element))
        step = 0
        while len(element):
            step = (step + int(_GOLDEN)) & 0xFFFFFFFFFFFFFFFF
            x = _mixed(element + np.uint64(step))
            time = time - np.log(((x >> np.uint64(24)).astype(float) + 0.5) * 2.0**-40) / registers
            near = time <= limit[owner]
            element, owner, time, x = element[near], owner[near], time[near], x[near]
            spot = ((x & np.uint64(0xFFFFFF)) * np.uint64(registers)) >> np.uint64(24)
            np.minimum.at(best, owner * registers + spot.astype(np.int64), time)
        best = best.reshape(len(held), registers)
        filled = np.isfinite(best).all(axis=1)
        level = np.floor(1 - (np.log(best[filled]) - math.log(RATE)) / math.log(BASE))
        out[todo[filled]] = np.clip(level, 0, LEVELS).astype(np.int16)
        todo, reach = todo[~filled], reach * 2
    return out


def hopeless(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of sketches whose similarity can't reasonably reach the threshold.

    With set sizes known, the joint likelihood of "a's register larger", "equal"
    and "smaller" is a function of the similarity alone.
    """
    larger, smaller = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - larger - smaller
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    top = np.minimum(u / v, v / u)
    j = np.concatenate([top * np.linspace(0, 1, 64)[None, :], np.minimum(top, threshold)], axis=1)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    over, under = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    like = larger * np.log(over + tiny) + smaller * np.log(under + tiny) + equal * np.log(np.maximum(1 - over - under, tiny))
    found = j[np.arange(len(j)), np.argmax(like, axis=1)]
    return (found < threshold) & (like.max(axis=1) - like[:, -1] > DOUBT)


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _sketched(docs: DataFrame, k: int, id_col: str, text_col: str, keyed: bool) -> DataFrame:
    """``id, tid, n, digest, regs`` for each row, and ``key`` of its text if ``keyed``; ``tid`` finds texts again."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tid"), text.cast("binary").alias("t"), *([_text_key(text).alias("key")] if keyed else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingle_hashes(t, k) for t in batch.column(2).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                regs: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, r in zip(full, sketches([sets[i] for i in full]), strict=True):
                        regs[i] = r.astype("<i2").tobytes()
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary()), *batch.columns[3:]],
                    names=["id", "tid", "n", "digest", "regs", *batch.schema.names[3:]],
                )

    return mapped(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, tid long, n long, digest binary, regs binary" + (", key binary" if keyed else ""))


def _bands(classes: DataFrame) -> DataFrame:
    """``key, nid`` for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i2").reshape(-1, BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, regs.shape[:2])
            for r in range(ROWS):
                key = _mixed((key * _GOLDEN) ^ regs[:, :, r].astype(np.uint64))
            nids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64).ravel()), pa.array(nids, pa.int64())], names=["key", "nid"])

    return mapped(classes.select("nid", "regs"), run, "key long, nid long")


def _texts(docs: DataFrame, classes: DataFrame, nids: DataFrame, k: int, text_col: str) -> tuple[DataFrame, str]:
    """``nid, t`` of the named classes, written once.

    Texts are found by a hash; one whose set is the class's set stands for the class.
    """
    wanted = classes.select("nid", "tid", "digest").join(nids, "nid", "left_semi")
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.xxhash64(text).alias("tid"), text.cast("binary").alias("t"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                hashlib.blake2b(shingle_hashes(t, k).tobytes(), digest_size=16).digest() == d
                for t, d in zip(batch.column("t").to_pylist(), batch.column("digest").to_pylist(), strict=True)
            ]
            yield batch.select(["nid", "t"]).filter(pa.array(keep, pa.bool_()))

    return written(mapped(source.join(wanted, "tid"), checked, "nid long, t binary").groupBy("nid").agg(F.min("t").alias("t")), "near-texts")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``pairs (a, b)`` without those that sizes or registers rule out."""
    per_cent = round(100 * threshold)
    c = classes.select("nid", "n", "regs")
    known = (
        pairs.join(c.toDF("a", "n_a", "r_a"), "a")
        .join(c.toDF("b", "n_b", "r_b"), "b")
        .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * per_cent)
    )

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r_a, r_b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), "<i2").reshape(batch.num_rows, -1) for x in ("r_a", "r_b"))
            n_a, n_b = (batch.column(x).to_numpy(zero_copy_only=False).astype(float) for x in ("n_a", "n_b"))
            keep = ~hopeless(r_a, r_b, n_a, n_b, threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return mapped(known, likely, "a long, b long")


def _with_text(rows: DataFrame, pairs: DataFrame, texts: DataFrame, key: str, other: str, total: int) -> DataFrame:
    """``rows`` with the text ``t_<key>`` of the class ``key``.

    A class in more than one of ``HOT_SHARES`` of all ``pairs``, a centre of many, is dealt
    over parts by the other class, and its text is repeated for each.  There are
    at most ``HOT_SHARES`` such classes, and twice as many parts.
    """
    many = pairs.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("c")).where((F.col("c") * HOT_SHARES > total) & (F.col("c") > 1))
    hot = F.broadcast(many.select("k", F.ceil(F.col("c") * HOT_SHARES / total).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(hot, F.col(key) == F.col("k"), "left").withColumn("part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("k", "parts")
    held = texts.join(hot, F.col("nid") == F.col("k"), "left").select(F.col("nid").alias(key), F.col("t").alias(f"t_{key}"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.join(held, [key, "part"]).drop("part")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> tuple[DataFrame, list[str]]:
    """Those of ``pairs (a, b)`` that are similar on their full sets, and written stages to discard."""
    hopeful, p_hopeful = written(pairs, "near-pairs")
    needed = hopeful.select(F.col("a").alias("nid")).union(hopeful.select("b")).distinct()
    own, total = texts.join(needed, "nid", "left_semi"), hopeful.count()
    both = _with_text(_with_text(hopeful, hopeful, own, "b", "a", total), hopeful, own, "a", "b", total).select("a", "b", "t_a", "t_b")

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            keep = []
            for a, t_a, t_b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, held = a, shingles(words_of(t_a), k)
                keep.append(similar(held, shingles(words_of(t_b), k), threshold))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links, p_links = written(mapped(both, decided, "a long, b long"), "near-links")
    return links, [p_hopeful, p_links]


def _prefix_pairs(left: DataFrame, texts: DataFrame, classes: DataFrame, k: int, per_cent: int) -> tuple[DataFrame, list[str]]:
    """``a, b`` of all classes of different roots in ``left`` that can be similar, by prefixes.

    ``left`` holds ``nid, root``.  Shingles are put in one order, the rarest first.  If
    two sets are similar, the first shingle they have in common stands so early in both
    that what follows still suffices; no other pair is made.  Of each shingle the most
    frequent root needs no pairs in itself, so its members only meet the others.
    """

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nid, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = shingle_hashes(t, k)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(np.full(len(hashes), nid))], names=["hash", "nid"])

    every = mapped(texts.join(left.select("nid"), "nid", "left_semi"), exploded, "hash long, nid long")
    counted, p_counted = written(every.groupBy("hash").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "near-counts")
    ranked = every.join(counted, "hash").groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("s"))
    ranked = ranked.join(left, "nid").join(classes.select("nid", "n"), "nid")
    # A class's own shingles come first and meet nothing.
    alone = (F.col("n") - F.size("s")).cast("int")
    early = (F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1).cast("int") - alone
    ranked = ranked.where(early > 0).select("nid", "root", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), early)).alias("i", "h"))
    prefix, p_prefix = written(ranked.select(F.col("h.hash").alias("hash"), "nid", "root", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("rest")), "near-prefixes")
    major, p_major = written(prefix.groupBy("hash", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("hash").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1"), "near-majors")
    meeting = prefix.join(major.select("hash", "major"), "hash")
    minor = meeting.where("root <> major").select("hash", F.col("nid").alias("x"), F.col("root").alias("root_x"), F.col("n").alias("n_x"), F.col("rest").alias("rest_x"))
    other = meeting.select("hash", F.col("nid").alias("y"), F.col("root").alias("root_y"), F.col("n").alias("n_y"), F.col("rest").alias("rest_y"))
    minor, p_minor = written(minor, "near-minor")
    other, p_other = written(other, "near-other")
    enough = F.least("rest_x", "rest_y") * (100 + per_cent) >= (F.col("n_x") + F.col("n_y")) * per_cent
    met = minor.join(other, "hash").where((F.col("root_x") != F.col("root_y")) & enough)
    return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), [p_counted, p_prefix, p_major, p_minor, p_other]


def components(links: DataFrame) -> DataFrame:
    """``nid, root`` for every end of ``links (a, b)``; equal roots are connected.

    Each round names every node by the least name around it, jumps once, and
    contracts the links; rounds follow the logarithm of a component's width.
    """
    spark = links.sparkSession
    edges, path = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "near-edges")
    mapping, old = None, []
    while True:
        near = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("p"))
        near = near.select(F.col("a").alias("u"), F.least("a", "p").alias("p"))
        jump = near.alias("x").join(near.alias("y"), F.col("x.p") == F.col("y.u")).select(F.col("x.u").alias("u"), F.col("y.p").alias("to"))
        step, p_step = written(jump, "near-step")
        if mapping is None:
            mapping, p_map = step.toDF("nid", "root"), None
        else:
            moved = mapping.join(step, F.col("root") == F.col("u"), "left").select("nid", F.coalesce("to", "root").alias("root"))
            mapping, p_map = written(moved, "near-map")
        new = (
            edges.join(step.toDF("a", "ta"), "a").join(step.toDF("b", "tb"), "b").where("ta <> tb")
            .select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct()
        )
        edges, p_new = written(new, "near-edges")
        old += [path, *([p_step] if p_map else [])]
        path = p_new
        if edges.isEmpty():
            discard(spark, *old, path)
            return mapping


def _unsettled(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``key, nid, root`` of the buckets whose members lie in several components."""
    if roots is None:
        return members.select("key", "nid", F.col("nid").alias("root"))
    placed = members.join(roots, "nid", "left").select("key", "nid", F.coalesce("root", "nid").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return placed.join(mixed, "key", "left_semi")


def _answered(docs: DataFrame, k: int, threshold: float, id_col: str, text_col: str, keyed: bool = False) -> DataFrame:
    """``id, n, digest, component`` of each row; if ``keyed``, also ``key`` and the ``chosen`` row of its component."""
    spark = docs.sparkSession
    rows, _ = written(_sketched(docs, k, id_col, text_col, keyed), "near-rows")
    # The first row of a class or component: one with an id, the smallest.
    first = [F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first")] if keyed else []
    chosen = [F.min(F.struct("first", "digest")).alias("chosen")] if keyed else []
    equal = rows.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("first_id"), F.min("tid").alias("tid"), F.first("n").alias("n"), F.first("regs").alias("regs"), *first
    )
    classes, p_classes = written(equal.withColumn("nid", F.monotonically_increasing_id()), "near-classes")

    banded = _bands(classes)
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members, p_members = written(banded.join(shared.select("key"), "key"), "near-buckets")

    texts, p_texts = _texts(docs, classes, members.select("nid").distinct(), k, text_col)

    tried = links = roots = None
    old: list[str] = [p_members, p_texts]
    for number, choices in enumerate(CENTRES):
        # Of each bucket that isn't in one component yet, the member that comes first
        # in one of a few random orders meets the members of other components.
        left, p_left = written(_unsettled(members, roots), "near-left")
        order = F.xxhash64(F.col("nid"), F.lit(number), F.pmod("key", F.lit(choices)))
        centres, p_centres = written(left.groupBy("key").agg(F.min_by(F.struct("nid", "root"), order).alias("c")), "near-centres")
        met = left.join(centres, "key").where(F.col("root") != F.col("c.root"))
        pairs = met.select(F.greatest("nid", "c.nid").alias("a"), F.least("nid", "c.nid").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs, p_pairs = written(pairs, "near-tried")
        tried = pairs if tried is None else tried.union(pairs)
        more, p_more = _verified(_likely(pairs, classes, threshold), texts, k, threshold)
        links = more if links is None else links.union(more)
        roots = components(links)
        old += [p_left, p_centres, p_pairs, *p_more]

    # What the centres didn't connect: all pairs of components that can be similar.  The
    # prefixes already bound what they have in common, so registers aren't asked again.
    left, p_left = written(_unsettled(members, roots).select("nid", "root").distinct(), "near-left")
    rest, p_rest = _prefix_pairs(left, texts, classes, k, round(100 * threshold))
    more, p_more = _verified(rest.join(tried, ["a", "b"], "left_anti"), texts, k, threshold)
    roots = components(links.union(more))
    discard(spark, *old, p_left, *p_rest, *p_more)

    held, more = (["first"], ["chosen"]) if first else ([], [])
    named = classes.select("digest", "first_id", *held, "nid").join(roots, "nid", "left").select("digest", "first_id", *held, F.coalesce("root", "nid").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component"), *chosen)
    answer, _ = written(named.join(least, "root").select("digest", "component", *more), "near-answer")
    discard(spark, p_classes)
    return rows.drop("tid", "regs").join(answer, "digest", "left")


def near_groups(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col, n_shingles, component_id, kept``."""
    found = _answered(docs, k, threshold, id_col, text_col)
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )


def drop_near_copies(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, columns unchanged.

    A row goes or stays by its own id and text, so ids may be null or shared.
    """
    found = _answered(docs, k, threshold, id_col, text_col, keyed=True)
    stays = (F.col("digest") == F.col("chosen.digest")) & F.col("id").eqNullSafe(F.col("chosen.first.id")) & (F.col("key") == F.col("chosen.first.key"))
    gone = found.where((F.col("n") > 0) & ~stays).select("id", "key").alias("gone")
    key = _text_key(F.coalesce(F.col(f"rows.`{text_col}`"), F.lit("")))
    return docs.alias("rows").join(gone, F.col(f"rows.`{id_col}`").eqNullSafe(F.col("gone.id")) & (key == F.col("gone.key")), "left_anti")
