"""URL filtering: rules first, naive Bayes over segmented words for the rest.

Rules name a host and a path prefix; a rule fits its host and all subdomains if
the url's path starts with the rule's, and the longest fitting rule decides.

Urls that no rule fits are scored.  Host labels and path parts are cut at marks
and digits, and concatenated names are segmented into words by a unigram Viterbi
search over the corpus's own word counts.  A multinomial naive Bayes model over
host and path tokens then compares the classes.  There are no labelled urls, so examples
are weak ones: urls that no rule decides and whose segmented host holds a word of
``seed_words`` stand for block, the others, most of which are harmless, for allow.  So
the model learns which other words of hosts and paths go with those hosts.  Urls that a
rule decides teach nothing: rules tell parts of sites apart, not kinds of sites.

Defined cases: a null url, or one without ``://``, has empty host and path, fits
no rule and is allowed, as is any url without tokens; urls that repeat are
judged alike; columns of other names don't matter; without examples everything
that no rule fits is allowed; an empty table gives an empty result.

Scale: no count is dropped, whatever its share of the corpus.  Names and tokens with
at least ``HOT_SHARE`` of all are broadcast, at most ``1 / HOT_SHARE`` of them and the
seeds; all others are joined by shuffles, where no key can hold more than that share.
A name meets the words in it by a join over its substrings, salted where they are
short; each distinct name is segmented once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import ChainMap, Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundsmith.llm.common import mapped, written

#: What makes up at least this share of all names or tokens is looked up in a broadcast table.
HOT_SHARE = 1e-4

#: The query's rules, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words that mark a host as one to block, with a large count for segmentation.
SEED_WORDS = tuple("ads adult bet bets bonus casino click escort free gambling lottery loan pills poker porn pharma slots spam track viagra win xxx".split())

_PART = re.compile(r"[^\W\d_]+")


def host_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(known, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(known, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


@dataclass
class Segmenter:
    """Unigram Viterbi: the split of a name with the largest product of word shares.

    Characters outside any word cost as a rare word of one letter.  Of equal
    splits the one whose last word is longest wins, from right to left.
    """

    counts: dict[str, int]
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        total = sum(self.counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in self.counts.items()}
        self.longest = max(map(len, self.counts), default=1)
        self.unknown = math.log(total) + math.log(20.0)

    def words(self, name: str) -> tuple[str, ...]:
        got = self.known.get(name)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[name] = split(name, self.cost, self.longest, self.unknown)
        return got


def split(name: str, cost: dict[str, float], longest: int, unknown: float) -> tuple[str, ...]:
    low, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        least, at = math.inf, end - 1
        for start in range(max(0, end - longest), end):
            c = cost.get(name[start:end], unknown if start == end - 1 else math.inf)
            if low[start] + c < least:
                least, at = low[start] + c, start
        low.append(least)
        back.append(at)
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return tuple(reversed(out))


def names_in(host: str | None, path: str | None) -> tuple[list[str], list[str]]:
    return _PART.findall((host or "").lower()), _PART.findall((path or "").lower())


def tokens(host: str | None, path: str | None, words: Callable[[str], Sequence[str]]) -> list[str]:
    """``h:`` and ``p:`` tokens of the segmented names."""
    hosts, paths = names_in(host, path)
    return [f"h:{w}" for n in hosts for w in words(n)] + [f"p:{w}" for n in paths for w in words(n)]


@dataclass
class Bayes:
    """Multinomial naive Bayes with add-one smoothing; positive scores mean block.

    ``block`` and ``allow`` are the classes' smoothed totals.
    """

    block: int
    allow: int
    prior: float

    def weight(self, b: int, a: int) -> float:
        return math.log((b + 1) / self.block) - math.log((a + 1) / self.allow)

    def score(self, found: list[str], counts: Mapping[str, tuple[int, int]]) -> float:
        return self.prior + sum(self.weight(*counts.get(t, (0, 0))) for t in found) if found else -1.0


def _salts(size: int) -> int:
    """Parts that a word of this length is dealt over: short ones are in many names."""
    return 64 if size <= 2 else 16 if size <= 4 else 1


def _segmented(parts: DataFrame, seed_words: tuple[str, ...]) -> tuple[DataFrame, int]:
    """``name, n, words`` of each distinct name, segmented by all words' counts and the seeds; and their total."""
    spark = parts.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: Counter[str] = Counter()
            for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hosts, paths = names_in(h, p)
                got.update(hosts)
                got.update(paths)
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], names=["w", "n"])

    per, _ = written(mapped(parts.select("host", "path"), count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "url-words")
    top = per.agg(F.max("n")).first()[0] or 1
    met = {r.w: r.n for r in per.where(F.col("w").isin(*seed_words)).collect()}
    seeds = spark.createDataFrame([(w, max(met.get(w, 0), top // 10, 1)) for w in seed_words], "w string, n long")
    words = per.where(~F.col("w").isin(*seed_words)).unionByName(seeds)
    total = words.agg(F.sum("n")).first()[0] or 1
    lengths = sorted(r[0] for r in words.select(F.length("w")).distinct().collect())
    unknown = math.log(total) + math.log(20.0)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            size = 0
            for name in batch.column(0).to_pylist():
                salt = zlib.crc32(name.encode("utf-8", "surrogatepass"))
                for n in lengths:
                    if n > len(name):
                        break
                    found = {name[at : at + n] for at in range(len(name) - n + 1)}
                    out += [(name, w, salt % _salts(n)) for w in found]
                    size += len(found) * (len(name) + n)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(("name", "w", "salt"), o, strict=True)) for o in out], schema=shape)
                        out, size = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(("name", "w", "salt"), o, strict=True)) for o in out], schema=shape)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ns, cuts = batch.column(0).to_pylist(), [], []
            for name, found in zip(names, batch.column(1).to_pylist(), strict=True):
                counts = {f["w"]: f["n"] for f in found}
                ns.append(counts[name])
                cuts.append(split(name, {w: -math.log(n / total) for w, n in counts.items()}, max(map(len, counts)), unknown))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ns, pa.int64()), pa.array(cuts, pa.list_(pa.string()))], names=["name", "n", "words"])

    shape = pa.schema([("name", pa.string()), ("w", pa.string()), ("salt", pa.int32())])
    size = F.length("w")
    salts = F.when(size <= 2, _salts(2)).when(size <= 4, _salts(4)).otherwise(_salts(5))
    dealt = words.select("w", "n", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    inside = mapped(per.select("w"), pieces, "name string, w string, salt int").join(dealt, ["w", "salt"])
    held = inside.groupBy("name").agg(F.collect_list(F.struct("w", "n")).alias("found"))
    return written(mapped(held, cut, "name string, n long, words array<string>"), "url-names")[0], total


def _met(rows: DataFrame, asked: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` and, in ``found``, the ``(key, value)`` of ``table`` for what each row ``rid`` asked."""
    got = asked.join(table, "key").groupBy("rid").agg(F.collect_list(F.struct("key", "value")).alias("found"))
    return rows.join(got, "rid", "left")


def judged(pages: DataFrame, rules: tuple = RULES, seed_words: tuple[str, ...] = SEED_WORDS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict, score`` for each row of ``pages``.

    ``score`` is the model's log odds of block, for every url.
    """
    host, path = host_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("i"), host.alias("host"), path.alias("path"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    rows, _ = written(parts.select(F.monotonically_increasing_id().alias("rid"), "i", "host", "path", rule.alias("rule"), by_rule.alias("by_rule")), "url-rows")
    context = pages.sparkSession.sparkContext
    names, total = _segmented(rows, seed_words)
    common = context.broadcast({r.name: r.words for r in names.where(F.col("n") >= HOT_SHARE * total).collect()})
    seeds = frozenset(seed_words)

    def rare_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, keys = [], []
            for rid, h, p in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                hosts, paths = names_in(h, p)
                rare = {*hosts, *paths} - common.value.keys()
                rids += [rid] * len(rare)
                keys += rare
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(keys, pa.string())], names=["rid", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, block = [], []
            for h, p, v, found in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "by_rule", "found")), strict=True):
                rare = {f["key"]: f["value"] for f in found or ()}
                every.append(tokens(h, p, lambda n: common.value.get(n) or rare[n]))
                block.append(int(any(t[2:] in seeds for t in every[-1] if t[0] == "h")) if v is None else None)
            kept = [batch.column(c) for c in ("rid", "i", "host", "path", "rule", "by_rule")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(every, pa.list_(pa.string())), pa.array(block, pa.int32())], names=["rid", "i", "host", "path", "rule", "by_rule", "t", "b"])

    kind = rows.schema["i"].dataType.simpleString()
    shape = f"rid long, i {kind}, host string, path string, rule string, by_rule string"
    asked = mapped(rows.select("rid", "host", "path"), rare_names, "rid long, key string")
    met = _met(rows, asked, names.select(F.col("name").alias("key"), F.col("words").alias("value")))
    rows, _ = written(mapped(met, cut, f"{shape}, t array<string>, b int"), "url-tokens")

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: Counter[tuple[str, int]] = Counter()
            for found, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got[("", block)] += 1
                got.update((t, block) for t in found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in got], pa.string()), pa.array([b for _, b in got], pa.int32()), pa.array(list(got.values()), pa.int64())], names=["t", "b", "n"]
            )

    per = mapped(rows.where("b is not null").select("t", "b"), examples, "t string, b int, n long").groupBy("t").agg(
        F.sum(F.when(F.col("b") == 1, F.col("n")).otherwise(0)).alias("block"), F.sum(F.when(F.col("b") == 0, F.col("n")).otherwise(0)).alias("allow")
    )
    counts, _ = written(per, "url-counts")
    urls = counts.where("t = ''").first()
    if urls is None or not (urls.block and urls.allow):
        scored = rows.withColumn("score", F.lit(-1.0))
    else:
        sums = counts.where("t <> ''").agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0)), F.count(F.lit(1))).first()
        model = Bayes(sums[0] + sums[2], sums[1] + sums[2], math.log(urls.block / urls.allow))
        hot = counts.where((F.col("t") != "") & (F.col("block") + F.col("allow") >= HOT_SHARE * (sums[0] + sums[1]))).collect()
        usual = context.broadcast({r.t: (r.block, r.allow) for r in hot})

        def rare_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rids, keys = [], []
                for rid, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rare = set(found) - usual.value.keys()
                    rids += [rid] * len(rare)
                    keys += rare
                yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(keys, pa.string())], names=["rid", "key"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = []
                for ts, found in zip(batch.column("t").to_pylist(), batch.column("found").to_pylist(), strict=True):
                    rare = {f["key"]: (f["value"]["block"], f["value"]["allow"]) for f in found or ()}
                    scores.append(model.score(ts, ChainMap(rare, usual.value)))
                kept = [batch.column(c) for c in ("rid", "i", "host", "path", "rule", "by_rule")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names=["rid", "i", "host", "path", "rule", "by_rule", "score"])

        asked = mapped(rows.select("rid", "t"), rare_tokens, "rid long, key string")
        met = _met(rows, asked, counts.select(F.col("t").alias("key"), F.struct("block", "allow").alias("value")))
        scored = mapped(met, run, f"{shape}, score double")
    verdict = F.coalesce("by_rule", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select(F.col("i").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
