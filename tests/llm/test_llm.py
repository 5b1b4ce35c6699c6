"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boundsmith.llm import decontam, exact, htmltext, minhash, packing, pii, quality, queries, tokenbin, tokencount, urlfilter
from boundsmith.llm.common import Cache, mapped, shared_dir, written
from boundsmith.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "a b", "x" * 5000, "a b " * 3000, "ß é\u3000日本", "line\nline\n\nline", "a\x00b", "<|endoftext|> x"]


def table(spark, texts, extra=True):
    """Documents with repeated rows, a null id and extra columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "1 as n", "'x' as hash", "2 as kept", "3 as i", "'y' as norm", "4 as score") if extra else df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    return lambda texts: [np.array(e.ids, "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


# Exact dedup -------------------------------------------------------------------

def test_exact(spark):
    df = table(spark, [*ODD, "A b", "a  b", "ab", " ab ", "a\tb"])
    got = {(r.doc_id): r for r in exact.exact_groups(df).collect()}
    assert exact.exact_groups(df).count() == df.count()
    same = [r for r in got.values() if r.text_sha256 == hashlib.sha256(b"ab").hexdigest()]
    assert {r.keep_id for r in same} == {12} and {r.group_size for r in same} == {5}  # the first of those with most code points
    assert [r.doc_id for r in same if r.kept] == [12]
    kept = exact.drop_exact_copies(df)
    assert kept.columns == df.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in df.collect()})
    assert exact.exact_groups(df.limit(0)).count() == 0 and exact.drop_exact_copies(df.limit(0)).count() == 0


def test_exact_with_colliding_hashes(spark):
    df = table(spark, ["a", "b", "c", "b ", "a"], extra=False)
    weak = lambda c: F.lit("same")
    plain = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(df).collect()}
    assert plain == {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(df, hash_of=weak).collect()}
    assert exact.drop_exact_copies(df, hash_of=weak).count() == exact.drop_exact_copies(df).count() == 4


def test_exact_with_clashing_names_and_hot_groups(spark):
    """Any column names; one text in a third of all rows, also under one id and none."""
    rows = [(i, f"text {i}") for i in range(60)] + [(100 + i, "the same  text" if i % 2 else "the same text") for i in range(20)] + [(7, "the same text!")] * 5 + [(None, "the same text!")] * 10
    names = ["hash", "sha", "norm", "row", "rows", "row_id", "len", "__hash", "__sha", "__neg", "__id", "g_key", "g_hash", "h_id", "c_id"]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"{k} as `{n}`" for k, n in enumerate(names)])
    kept = exact.drop_exact_copies(df)
    assert kept.columns == df.columns and kept.count() == 62
    assert {r.doc_id for r in kept.where("text like 'the%'").collect()} == {101, 7}
    plain, exact.HOT_GROUPS = exact.HOT_GROUPS, 10**9  # all groups by broadcast; then none
    hot = sorted(map(repr, exact.exact_groups(df).collect()))
    exact.HOT_GROUPS = 1
    cold = sorted(map(repr, exact.exact_groups(df).collect()))
    exact.HOT_GROUPS = plain
    assert hot == cold == sorted(map(repr, exact.exact_groups(df).collect()))


# Near dedup --------------------------------------------------------------------

def brute_components(rows, k, threshold=0.8):
    sets = [minhash.shingles(minhash.words_of((t or "").encode()), k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and minhash.similar(sets[i], sets[j], threshold):
                root[find(i)] = find(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            name[find(i)] = min(name.get(find(i), d), d)
    return sorted((str(d), len(s), str(d if not s else name.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_near_groups_equal_brute_force(spark):
    random.seed(3)
    vocab = [f"w{i}" for i in range(300)]
    base = [[random.choice(vocab) for _ in range(random.choice([3, 8, 60, 150]))] for _ in range(12)]
    texts = list(ODD)
    for b in base:
        for _ in range(9):
            t = list(b)
            for _ in range(random.randint(0, max(1, len(t) // 12))):
                t[random.randrange(len(t))] = random.choice(vocab)
            texts.append(" ".join(t).upper() if random.random() < 0.3 else " ".join(t))
    df = table(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = minhash.near_groups(df, k=2)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute_components(rows, 2)
    kept = minhash.drop_near_copies(df, k=2)
    assert kept.columns == df.columns and kept.where("doc_id = 0").count() == 2
    assert minhash.near_groups(df.limit(0)).count() == 0


def test_near_copies_are_dropped_by_row(spark):
    """Ids may be shared or null: a row goes only if its own text is a near copy."""
    text = lambda name, last="": " ".join(f"{name}{i}" for i in range(100)) + last
    rows = [(1, text("a")), (5, text("a", " x")), (5, text("b")), (7, text("c")), (7, text("c", " y")), (7, text("c").upper()), (None, text("d")), (None, text("d", " z")), (None, text("e")), (9, text("f", " q")), (None, text("f")), (None, ""), (None, None), (5, "")]
    got = minhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    full = sorted((r.text.split()[0].lower(), r.doc_id) for r in got if r.text)
    assert full == [("a0", 1), ("b0", 5), ("c0", 7), ("d0", None), ("e0", None), ("f0", 9)] and len(got) == 9


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    whole, left, right = minhash.sketches([a, a[:500], a[400:]])
    assert (np.maximum(left, right) == whole).all()
    near, far = minhash.sketches([np.concatenate([a[:850], a[:50] + np.uint64(1)]), np.concatenate([a[:300], a[:600] + np.uint64(1)])])
    n = np.array([900.0])
    assert not minhash.hopeless(whole[None], near[None], n, n, 0.8)[0]
    assert minhash.hopeless(whole[None], far[None], n, n, 0.8)[0]


# Decontamination ---------------------------------------------------------------

def brute_hits(text, items, width=10):
    words = decontam.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        iw = decontam.words_of(t)
        size = min(width, len(iw))
        windows = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(str(f) for f in found if f is not None)).encode()).hexdigest()


@pytest.mark.parametrize("block_words", [decontam.BLOCK_WORDS, 60])
def test_contamination_equals_brute_force(spark, block_words):
    random.seed(4)
    word = lambda: random.choice(["a", "b", "c", "d"])
    items = [(i, " ".join(word() for _ in range(random.choice([1, 2, 5, 9, 10, 14])))) for i in range(25)] + [(None, "q r s"), (98, None), (99, ""), (7, "zz yy"), (7, "zz yy")]
    texts = [*ODD, *[" ".join(word() for _ in range(random.randint(0, 80))) for _ in range(60)], "x Q-r, S!", "zz yy"]
    df = table(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 as doc_id")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(df, bench, block_words=block_words).collect())
    want = sorted((str(r.doc_id), *(b := brute_hits(r.text, items)), b[1] > 0) for r in df.collect())
    assert got == want
    clean = decontam.drop_contaminated(df, bench, block_words=block_words)
    assert clean.columns == df.columns and clean.count() == sum(not w[-1] for w in want)
    assert decontam.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(df.limit(0), bench).count() == 0


def test_contamination_tables_are_bounded():
    """A block's tables grow with its words, also where all words differ or all are the same."""
    import pickle

    n = 20_000
    for text in (" ".join(f"w{i}" for i in range(n)), "a " * n, " ".join(f"w{i % 50}" for i in range(n))):
        block = decontam.block_of([(1, decontam.words_of(text))])
        assert len(pickle.dumps(block)) < 100 * n
        assert len(block.hits(decontam.words_of(text))[0]) == n - 9


def test_benchmark_items_longer_than_a_block(spark):
    words = [f"w{i}" for i in range(500)]
    bench = spark.createDataFrame([("long", " ".join(words)), ("short", "w3 w4")], "item_id string, text string")
    blocks = list(decontam.item_blocks(bench, block_words=100))
    assert len(blocks) > 5 and all(len(s.words) <= 400 for b in blocks for s in b.searchers)
    df = spark.createDataFrame([(i, " ".join(["x", *words[i : i + 12], "y"])) for i in range(0, 488, 7)], "doc_id long, text string")
    got = decontam.contamination(df, bench, block_words=100).collect()
    assert all(r.n_hit == 12 and r.n_items == 1 + (r.doc_id == 0) for r in got) and len(got) == 70


# Personal data -----------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for n, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(d) <= 19 and sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0,
                "phone": 10 <= len(d) <= 15,
            }[kind]
            if good:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_pii_base_equals_plain_patterns(spark):
    random.seed(5)
    alphabet = list("0123456789") * 2 + list("  --..++@@()ab%_é") + ["😀", "4111111111111111", "1.2.3.4", "a.b@c-d.ef", "+1 (017) 555-7713", " at ", " dot ", "0" * 30]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(400)] + [*ODD, "1 " * 3000, "4111111111111111 x " * 300, "a@b.c" * 600]
    df = table(spark, texts)
    described, _ = written(pii.candidates(df), "test")
    got = sorted((str(r.doc_id), [(s.start, s.kind, s.end) for s in r.base]) for r in pii.find_spans(described, pii.fit(described)).collect())
    assert got == sorted((str(r.doc_id), brute_spans(r.text)) for r in df.collect())
    none, _ = written(pii.candidates(df.limit(0)), "test")
    assert pii.find_spans(none, pii.fit(none)).count() == 0


def test_pii_model_adds_what_its_examples_show(spark):
    good = [f"{i} call 4111111111111111 now" for i in range(150)] + [f"{i} call 7111111111111112 now" for i in range(150)]
    texts = [*good, "pair 4111111111111111 4111111111111111 end", "pair 4111111111111112 7111111111111112 end", "order 4111111111111111 4111111111111111 end"]
    df = table(spark, texts, extra=False)
    described, _ = written(pii.candidates(df), "test")
    model = pii.fit(described)
    rows = {r.doc_id: r for r in pii.find_spans(described, model).collect()}
    assert model.trees[2] and len(rows[300].spans) == 2 and not rows[300].base  # each card of a pair, that the plain pattern takes for one number
    assert all(len(rows[i].spans) == 0 for i in range(150, 300)) and not rows[301].spans
    assert len(rows[302].spans) <= 1  # the first follows a word for an identifier
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in rows.values())


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_pii_adds_only_what_passes_its_check(spark, sf):
    """Added spans touch no base span and no other one, and hold no number that fails its check, at any size."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    described, _ = written(pii.candidates(docs), "test")
    model = pii.fit(described)
    rows = pii.find_spans(described, model).where("size(spans) > size(base)").join(docs, "doc_id").collect()
    for r in rows:
        spans = sorted((s.start, s.end, s.kind) for s in r.spans)
        given = {(s.start, s.end, s.kind) for s in r.base}
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]) if a not in given or b not in given)
        for start, end, kind in set(spans) - given:
            digits = re.sub("[^0-9]", "", r.text[start:end])
            if pii.KINDS[kind] == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                assert 14 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0
            if pii.KINDS[kind] == "phone":
                assert 10 <= len(digits) <= 15
    found = described.selectExpr("held_out", "explode(found) c").where("held_out and c.label is not null").groupBy("c.kind", "c.bits").agg(F.count("*").alias("n"), F.sum("c.label").alias("p")).collect()
    for kind in range(4):
        taken = [r for r in found if r.kind == kind and r.bits in model.accepted(kind)]
        assert not taken or sum(r.p for r in taken) >= pii.PRECISION * sum(r.n for r in taken)


def test_pii_thresholds_take_whole_scores():
    """Patterns of equal score are accepted or not together, whatever their order."""
    for order in (1, -1):
        counts = dict([(1, (0, 100)), (2, (1, 0)), (3, (60, 0))][::order])
        assert pii.calibrated({1: 2.0, 2: 1.0, 3: 1.0}.get, counts) == pytest.approx(2.0, abs=1e-6)
    assert pii.calibrated({1: 2.0}.get, {1: (0, 3)}) == float("inf") and pii.calibrated({}.get, {}) == float("inf")


def test_pii_scans_long_arrays(spark):
    text = " ".join(f"u{i}@mail.example.com 4111111111111111 4111111111111111 x" for i in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    described, _ = written(pii.candidates(df), "test")
    row = described.collect()[0]
    assert [(s.start, s.kind, s.end) for s in row.base] == brute_spans(text)
    assert sum(c.label == 1 for c in row.found) == 3000 and sum(c.kind == 2 and not c.meets for c in row.found) == 6000


# Quality -----------------------------------------------------------------------

def brute_score(model, text):
    """The score from n-grams one by one."""
    import xxhash

    mask = (1 << 64) - 1
    mix = [int(m) for m in quality._MIX]

    def hashes(token):
        word = token.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())).lower() or token

        def run(m):
            t = m[0]
            return "9" if not t[0].isalpha() else "a" if t.islower() or not t[0].isupper() else "A" if t.isupper() and len(t) > 1 else "Aa"

        return xxhash.xxh32_intdigest(word.encode()), xxhash.xxh32_intdigest(re.sub(r"[^\W\d_]+|\d+", run, token).encode(), 1)

    both = [hashes(t) for t in (text or "").split()]
    w, s = [b[0] for b in both], [b[1] for b in both]
    top = lambda v: (v & mask) >> (64 - quality.BITS)
    grams = [[top((x * mix[0] + mix[2]) * mix[1]) for x in w], [top((x * mix[0] + 2 * mix[2]) * mix[1]) for x in s], [], [], []]
    for i in range(len(both) - 1):
        pair = 0 if both[i] == both[i + 1] else (w[i] * mix[0] + w[i + 1] * mix[2]) & mask
        grams[2].append(top((pair ^ (pair >> 29)) * mix[1]))
        grams[3].append(top(((s[i] * mix[1] + s[i + 1] * mix[0]) & mask) * mix[2]))
    for i in range(len(both) - 2):
        grams[4].append(top(((s[i] * mix[1] + s[i + 1] * mix[0] + s[i + 2] * mix[2]) & mask) * mix[0]))
    total = model.bias + sum(np.mean([float(model.weights[g]) for g in kind]) for kind in grams if kind)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, model).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    odd = table(spark, ODD)
    got = quality.scored(odd, model)
    assert got.count() == odd.count() and got.where("score < 0 or score > 1").count() == 0
    assert quality.accepted(odd, model).columns == odd.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert r.score == pytest.approx(brute_score(model, texts[r.doc_id]), abs=1e-5)
    assert brute_score(model, "x" * 30 + "1") != brute_score(model, "x" * 30 + "-")  # whole tokens, however long
    untaught = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.scored(odd, untaught).collect()} == {0.5}
    assert quality.scored(odd.limit(0), model).count() == 0


# Tokens ------------------------------------------------------------------------

def test_encoder_equals_library(library):
    random.seed(6)
    pieces = ["a", "b's", " ", " ", "the", "  ", "\n", "\t", "\r", "\x00", "\x01", "\x0b", "\x1c", "\xa0", "é", "1", "23", "!", "?!", ".", "½", "²", "'", "'ll", "<|endoftext|>", "\u200b", "😀", "\u3000", "\n\n", "́", "ʰ"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 14))) for _ in range(8000)]
    e = Encoder(queries.tokenizer_path(), entries=500, part_bytes=2000)
    assert list(e.encode(pa.array([*texts, None]))) == [x.tobytes() for x in library(texts)] + [b""]


def test_token_records_round_trip(spark, docs, library, tmp_path):
    df = table(spark, ODD)
    shards = tokenbin.write_records(df, queries.tokenizer_path(), path=f"file://{tmp_path}/s")
    got = sorted(tokenbin.read_records(spark, shards).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in df.collect())
    ids = [np.append(x, np.uint32(2)).astype("<u4").tobytes() for x in library([t for _, t in rows])]
    assert [r.ids for r in got] == ids and [r.doc_id for r in got] == [None, 0, *range(len(ODD))]
    assert [r.start for r in got] == list(np.cumsum([0, *[len(i) // 4 for i in ids[:-1]]]))
    assert tokenbin.read_records(spark, tokenbin.write_records(df.limit(0), queries.tokenizer_path())).count() == 0
    name = next(s[0] for s in shards if s[1])
    data = bytearray(open(name.removeprefix("file://") + ".bin", "rb").read())
    data[-6] ^= 1
    open(name.removeprefix("file://") + ".bin", "wb").write(data)
    with pytest.raises(ValueError, match="checksum"):
        list(tokenbin.read_shard(name))
    assert tokenbin.from_payload(tokenbin.to_payload(3, np.array([70000], "<u4").tobytes())) == (3, np.array([70000], "<u4").tobytes())


def test_packing(spark, library):
    df = table(spark, [*ODD, *["word " * random.Random(i).randint(1, 3000) for i in range(40)]])
    for buffer in (1 << 20, 3000):
        pieces = packing.pack(df, queries.tokenizer_path(), buffer_tokens=buffer).collect()
        seqs, docs_ = {}, {}
        for p in pieces:
            seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
            docs_.setdefault(p.doc_id, []).append((p.start, p.ids))
        sizes = []
        for v in seqs.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
            sizes.append(at)
        assert max(sizes) <= 1024 and all(s & (s - 1) == 0 for s in sizes)
        want = {}
        for r, ids in zip(df.collect(), library([r.text or "" for r in df.collect()]), strict=True):
            want[r.doc_id] = want.get(r.doc_id, 0) + len(ids) + 1
        assert {d: sum(len(i) // 4 for _, i in v) for d, v in docs_.items()} == want
        assert sum(s != 1024 for s in sizes) <= 10 * df.rdd.getNumPartitions()  # what a task has left, at powers of two
        # Each document's pieces, in order, are the library's ids and the end id, once.
        rows = [(r.doc_id, np.append(ids, np.uint32(0)).astype("<u4").tobytes()) for r, ids in zip(df.collect(), library([r.text or "" for r in df.collect()]), strict=True)]
        for d in want:
            copies = [ids for i, ids in rows if i == d]
            assert all(p.length == len(p.ids) // 4 and p.doc_tokens in {len(c) // 4 for c in copies} for p in pieces if p.doc_id == d)
            cut = sorted((p.start, p.ids) for p in pieces if p.doc_id == d)
            if len(copies) == 1:
                at = 0
                for start, ids in cut:
                    assert start == at
                    at += len(ids) // 4
                assert b"".join(i for _, i in cut) == copies[0]
            else:
                assert sum(len(i) for _, i in cut) == sum(map(len, copies)) and all(any(ids == c[4 * start : 4 * start + len(ids)] for c in copies) for start, ids in cut)
    assert packing.pack(df.limit(0), queries.tokenizer_path()).count() == 0


def test_best_fill_is_optimal():
    from itertools import product

    random.seed(7)
    for _ in range(200):
        counts = {random.randint(1, 12): random.randint(1, 3) for _ in range(4)}
        cap = random.randint(1, 30)
        taken = packing.best_fill(counts, cap)
        sums = {sum(n * k for n, k in zip(counts, ks, strict=True)) for ks in product(*[range(c + 1) for c in counts.values()])}
        assert all(taken[n] <= counts[n] for n in taken) and sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= cap)


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_equal_library(spark, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    small = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁", -1.0), ("▁a", -2.0), ("<0x63>", -5.0)]
    large = tokencount.sentencepiece_vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    random.seed(8)
    pieces = ["a", "b", "c", " ", "ab", "é", "▁", "\n", "日", "the", "  ", "x", "\x00"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 12))) for _ in range(3000)] + [t for t in ODD if t]
    for vocabulary in (small, large):
        t = Tokenizer(models.Unigram(vocabulary, 0, fallback))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
        assert tokencount.Counter(vocabulary, 0, fallback).counts(pa.array([tokencount.marked_start(x) for x in texts])) == want
    df = table(spark, ODD)
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(df, large).collect()}
    assert got[0] == got[1] == 0 and tokencount.token_counts(df.limit(0), large).count() == 0


# Pages -------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div class="site-header"><a href=/>Home</a></div><div class=cookie-notice>We use cookies</div>
<nav><ul><li>menu</ul></nav><div class="page p12"><div class="content"><h2>Title&nbsp;A</h2><p>One <b>two</b> <a href=x>three</a> four&amp;five six seven eight nine.<p>Second para<br>line<ul><li>item 1<li>item 2</ul>
<script>var t="</p>";</script><!-- hidden --><div class="share">Share</div></div><aside>side</aside></div><section id="comments"><p>a reader says much more than you would think here</p></section><form><p>Subscribe</p></form><footer>foot</footer></body></html>"""
TEXT = "Title A One two three four&five six seven eight nine. Second para line item 1 item 2"


def test_main_text(spark):
    pages = [(i, f"http://h.example/{i}", PAGE) for i in range(4)] + [(4, None, None), (5, "", ""), (6, "http://h.example/x", "plain words only"), (7, "x", "<p>a<p>b &lt;c"), (8, "http://h.example/y", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as text", "3 as path")
    got = {r.page_id: r for r in htmltext.main_text(df).collect()}
    assert all(got[i].text == TEXT and got[i].n_chars == len(TEXT) for i in range(4))
    assert [got[i].text for i in range(4, 9)] == ["", "", "plain words only", "a b <c", "deep"]
    assert htmltext.main_text(df.limit(0)).count() == 0
    assert htmltext.vote(PAGE)[0].path() == "body>div.p#.page>div.content"


def test_deep_pages_take_linear_time():
    import time

    for page in ("<div>" * 100_000 + "deep", "<p><td>" + "<div>" * 50_000 + "deep", "<li><ul>" * 50_000 + "deep", "<p><b>" * 50_000 + "deep"):
        began = time.thread_time()
        assert htmltext.extract(page).split()[-1] == "deep" and htmltext.vote(page)[0] is not None
        assert time.thread_time() - began < 20


def test_main_text_by_consensus_with_many_layouts(spark):
    """Thirty layouts on one host: each page's path wins by those pages that have it, also on the odd page out."""
    page = lambda k, a, b: f'<body><div class="top x{chr(97 + k // 26)}{chr(97 + k % 26)}"><div class="inner q{chr(97 + k // 26)}{chr(97 + k % 26)}">{a}</div><div class="extra">{b}</div></div></body>'
    rows = [(100 * k + i, "http://h/", page(k, "long text " * 9, "short")) for k in range(30) for i in range(8)]
    rows += [(100 * k + 50, "http://h/", page(k, "short words", "another text that is longer than the article " * 2)) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.main_text(df).collect()}
    assert len(got) == len(rows) and all(got[100 * k + 50] == "short words" for k in range(30))
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # the shuffled join gives the same
    assert {r.page_id: r.text for r in htmltext.main_text(df).collect()} == got
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)


def test_main_text_equals_what_pages_were_made_of(spark):
    """Pages made of known paragraphs and known clutter: exactly the paragraphs come back."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for host in range(6):
        wrap = [("<article>", "</article>"), ('<div class="post-body">', "</div>"), ("<main><div>", "</div></main>")][host % 3]
        for i in range(8):
            parts = [words(rng.randint(12, 60)) for _ in range(rng.randint(1, 6))]
            title = words(4)
            body = f"<h1>{title}</h1>" + "".join(rng.choice(["<p>{}</p>", "<p>{}", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>"]).format(p.replace(" ", rng.choice([" ", "\n ", "&nbsp;"]), 3)) for p in parts)
            page = f'<html><head><title>{words(3)}</title><script>var a="<p>{words(5)}</p>"</script></head><body><header>{words(5)}</header><nav><a href=/>{words(2)}</a></nav>{wrap[0]}{body}<!-- {words(5)} --></p>{wrap[1]}<aside>{words(9)}</aside><div class="comments">{words(30)}</div><form>{words(4)}</form><footer>{words(8)}</footer></body></html>'
            rows.append((10 * host + i, f"http://h{host}/{i}", page))
            want[10 * host + i] = " ".join([title, *parts])
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_main_text_follows_the_host(spark):
    page = lambda a, b: f'<body><div class="story">{a}</div><div class="teaser">{b}</div></body>'
    rows = [(i, "http://h/", page("long text " * 9, "short")) for i in range(20)] + [(20, "http://h/", page("short story", "a teaser that is longer than the story " * 2))]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[20] == "short story"


def test_main_text_keeps_what_stands_around_the_longest_box(spark):
    long = "long text of the article " * 40
    bodies = [
        f"<div class=post><h1>Title</h1><p>lead</p><div class=body><p>{long}</p></div></div>",
        f"<article><h1>Title</h1><div><div>lead {long}</div></div></article>",
        f"<div class=post><h1><a href=/x>Title</a></h1><div>lead {long}</div></div>",
        f"<div><section><h2>Title</h2><p>lead</p></section><section><p>{long}</p></section></div>",
        f"<div><ul><li>Title<li>lead</ul><div><p>{long}</p></div></div>",
        f"<div><table><tr><td>Title<td>lead</table><div><p>{long}</p></div></div>",
    ]
    around = "<nav><a href=/>Home</a></nav>{}<div class=links><a href=/1>another page</a> <a href=/2>and one more</a></div>"
    rows = [(10 * k + i, f"http://h{k}/{i}", f"<body>{around.format(b)}</body>") for k, b in enumerate(bodies) for i in range(3)]
    rows.append((99, "http://h9/", f"<body><div class=wrap><div class=story>{long}</div><div class=links>x <a href=/1>another page</a></div></div></body>"))
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title lead {long}".strip() for i, _, _ in rows[:-1]) and got[99] == long.strip()


# Urls --------------------------------------------------------------------------

def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
    host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?y", "http://example.org/en/12#z", "http://a.com/fr/1", "http://com/de/", "http://b.com/de/2", "http://xorg/", "http://x.org", "http://x.org?/a", "http://a.net/a://b/fr/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 2)], "page_id long, url string").selectExpr("*", "1 as host", "2 as rule")
    for r in urlfilter.judged(df).collect():
        host, path, rule, verdict = brute_rule(urls[r.page_id % len(urls)])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert urlfilter.judged(df.limit(0)).count() == 0


def test_url_model_and_segmentation(spark):
    s = urlfilter.Segmenter({"casino": 50, "win": 40, "news": 60, "daily": 30, "a": 5})
    assert s.words("casinowin") == ("casino", "win") and s.words("dailynews") == ("daily", "news") and s.words("") == ()
    assert "".join(s.words("xxnewsq")) == "xxnewsq"
    good = [f"http://dailynews{i % 7}.net/story/{i}" for i in range(300)]
    bad = [f"http://casino-win{i}.net/play/{i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate([*good, *bad, "http://winbonus.net/play/x"])), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judged(df).collect()}
    assert all(got[i] == "allow" for i in range(300)) and all(got[i] == "block" for i in range(300, 361))


def test_url_model_learns_more_than_its_seeds(spark):
    """Words that go with seed hosts block another host; parts that rules block teach nothing."""
    good = [f"http://dailynews{i % 7}.net/story/{i}" for i in range(300)] + [f"http://garden{i % 5}.net/es/plants/{i}" for i in range(60)]
    bad = [f"http://casino-win{i}.net/play/jackpot/{i}" for i in range(60)] + [f"http://example.org/es/plants/{i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate([*good, *bad, "http://someplace.net/play/jackpot/x", "http://elsewhere.net/es/plants/y"])), "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judged(df).collect()}
    assert all(got[i].verdict == "allow" for i in range(360)) and all(got[i].verdict == "block" for i in range(360, 620))
    assert got[620].verdict == "block" and got[621].verdict == "allow"


def test_url_model_keeps_rare_tokens(spark):
    """More tokens than any fixed share of them lets count: scores equal those from all counts."""
    word = lambda i: hashlib.md5(str(i).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:9]
    urls = [f"http://{word(i)}.{'com/de' if i % 2 else 'net/en'}/{word(-i)}/{word(i % 50)}" for i in range(1, 25_001)] + ["http://viagra-x.net/"]
    got = {r.page_id: r for r in urlfilter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)).collect()}
    split = [urlfilter.names_in(*brute_rule(u)[:2]) for u in urls]
    counts = {}
    for n in (n for hosts, paths in split for n in hosts + paths):
        counts[n] = counts.get(n, 0) + 1
    assert sum(counts.values()) > 100_000
    top = max(counts.values())
    s = urlfilter.Segmenter(counts | {w: max(counts.get(w, 0), top // 10, 1) for w in urlfilter.SEED_WORDS})
    found = [[f"h:{w}" for n in hosts for w in s.words(n)] + [f"p:{w}" for n in paths for w in s.words(n)] for hosts, paths in split]
    seen, rows = {}, [0, 0]
    for u, ts in zip(urls, found, strict=True):
        if brute_rule(u)[3]:
            continue
        block = any(t[:2] == "h:" and t[2:] in urlfilter.SEED_WORDS for t in ts)
        rows[block] += 1
        for t in ts:
            seen.setdefault(t, [0, 0])[block] += 1
    sums = [sum(c[k] for c in seen.values()) + len(seen) for k in (0, 1)]
    for i, ts in enumerate(found):
        counts = [seen.get(t, [0, 0]) for t in ts]
        want = np.log(rows[1] / rows[0]) + sum(np.log((c[1] + 1) / sums[1]) - np.log((c[0] + 1) / sums[0]) for c in counts)
        assert got[i].score == pytest.approx(want)
        assert got[i].verdict == (brute_rule(urls[i])[3] or ("block" if want > 0 else "allow"))
    assert len(got) == len(urls) and "h:viagra" in found[-1]


# Python workers ----------------------------------------------------------------

def test_caches_are_bounded_and_released(spark):
    made = []
    cache = Cache(100, lambda k: made.append(k) or len(k))
    for _ in range(50):
        cache.turn()
        for i in range(40):
            assert cache[f"{i}"] == len(f"{i}")
    assert len(made) == 40  # what is asked for often stays
    for i in range(10_000):
        cache.turn()
        assert cache["x" * (i % 90) + f"{i}"] == i % 90 + len(f"{i}")
        assert len(cache) + len(cache.old) <= 102 and all(len(k) <= 64 for k in cache)
    cache.release()
    assert not cache and not cache.old

    def count(batches):
        for batch in batches:
            quality.ngrams("a b c")
            yield pa.RecordBatch.from_arrays([pa.array([len(quality._TOKENS)])], names=["n"])

    frame = spark.range(0, 4, 1, 4)
    for _ in range(2):  # workers serve again and again, but each task begins without entries
        assert {r.n for r in mapped(frame, count, "n long").collect()} == {3}


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, other=None: other)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


# Registered queries and the pipeline -------------------------------------------

def test_pipeline_with_defined_cases(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names; and empty tables."""
    import corpus_pipeline as P

    good = " ".join(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 300").orderBy("doc_id").limit(3).collect() if r.text)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*ODD, good, good + " ", good * 40])] + [(None, good, None, None, None), (None, None, None, None, None), (3, good, "en", "s", 1), (3, good, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, docs in (("full", df.selectExpr("*", "1 as hash", "2 as digest", "3 as n", "4 as id", "'k' as key")), ("none", df.limit(0))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in P.STAGES[:-1]:
            kept = stage(spark, docs, folder)
            assert kept.columns == docs.columns
            docs, _ = written(kept, "test")
        left = docs.count()
        pieces = P.run(spark, folder)
        assert pieces.where("start = 0").count() == left and (name == "full") == (left > 0)



def test_queries_with_sql(spark):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        want = con.sql(sql).df()[columns]
        got = df.toPandas()[columns]
        assert sorted(map(repr, got.values.tolist())) == sorted(map(repr, want.values.tolist())), name


def test_pipeline_stages_equal_brute_force(spark, library):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    rows = [r for r in rows if model.score(r[1]) >= quality.THRESHOLD]
    best = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1, 0, "")), (-len(t), i, t))
    rows = sorted((i, t) for _, i, t in best.values())
    names = brute_components(rows, 5)
    rows = [r for r in rows if (str(r[0]), str(r[0])) in {(a, c) for a, _, c in names}]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not brute_hits(r[1], items)[1]]
    want = {i: len(x) + 1 for (i, _), x in zip(rows, library([t for _, t in rows]), strict=True)}
    got = P.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == want and len(P.STAGES) == 5
