"""Every operator against a plain version: real rows, and rows with nulls, ties, repeats, long and empty texts."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.functions import webp as codec
from pixelloom.llm import ann, byte_bpe, components, langid, linededup, mail, packing, queries, simhash, store, suffixarray, suffixdedup, token_files, toxicity, webp
from pixelloom.llm.library_tokens import encoder

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("h", T.StringType()), T.StructField("kept", T.IntegerType())]
)
BPE, JSON, WORD, MULTI = (P.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))


def odd_rows():
    """Odd texts under distinct ids, with columns whose names clash with the operators' own."""
    rnd = random.Random(3)
    passage = "".join(rnd.choice("abcdef ghi") for _ in range(120))
    texts = [None, "", " ", "\n\n", "a", passage, passage, "x" + passage[:50], passage[:49], passage[30:90] + "é" + passage[:70], "é" * 60, "é" * 60 + "!"]
    texts += ["Same line\nother %d\n  SAME LINE\t" % i for i in range(12)]
    texts += ["".join(rnd.choice("ab \n\té漢'1.́\x1c") for _ in range(rnd.randint(0, 80))) for _ in range(60)]
    texts += [passage * 40 + "z" * 3000, "word " * 5000, "a" * 20000]
    return [(i * 3, t, "en" if i % 2 else None, "clash", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def files_of(docs, tmp):
    out = store.shared_dir(docs.sparkSession, "test-files")
    token_files.write(docs, JSON, out)
    return token_files.read(docs.sparkSession, out)


LABELS = [(i, 0, i % 2) for i in range(40)]
OPERATORS = {
    "op3": lambda d: files_of(d, None),
    "op6": lambda d: toxicity.classify(d, d.sparkSession.createDataFrame(LABELS, "doc_id long, quality int, toxic int")),
    "op1": suffixdedup.digests,
    "op2": lambda d: byte_bpe.digests(d, BPE, P.PATTERN),
    "op4": simhash.near_duplicates,
    "op5": lambda d: langid.identify(d, MULTI),
    "op8": lambda d: packing.packed(d, WORD),
    "op9": webp.digests,
    "op10": linededup.digests,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_and_null_ids(spark, empty, name):
    assert OPERATORS[name](empty).collect() == []
    rows = spark.createDataFrame([(None, "one two", None, "", 0), (None, None, None, "", 0), (5, "one two", None, "", 0), (5, "one two", None, "", 0)], SCHEMA)
    out = OPERATORS[name](rows).collect()
    first = [r for r in out if "start" not in r or name == "op3" or r["start"] == 0]
    assert sorted(str(r["doc_id"]) for r in first) == ["5", "5", "None", "None"]
    # equal texts have equal values, whatever their ids are; null text is like the empty one
    values = [tuple(r[c] for c in {"op2": ["n_tokens", "ids_sha256"], "op3": ["n_tokens", "ids_crc32"], "op4": ["fingerprint"], "op5": ["lang_pred", "score"], "op6": ["score", "predicted"], "op8": ["doc_tokens"], "op9": ["payload_sha256", "media_sha256", "feature"]}.get(name, ["kept_sha256"])) for r in first]
    assert sorted(Counter(values).values()) == [1, 3] or (name in ("op5", "op6") and len(set(values)) == 1)  # nothing to learn from
    if name == "op5" or name == "op6":
        assert all(r["held_out"] for r in out if r["doc_id"] is None)


@pytest.mark.parametrize("name, plain", [("op1", brute.suffix_dedup), ("op4", brute.simhash), ("op10", brute.line_dedup)])
def test_equals_brute_force(spark, odd, name, plain):
    assert by_id(OPERATORS[name](odd)) == plain(pairs(odd))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert by_id(OPERATORS[name](docs)) == plain(pairs(docs))


def by_value(module):
    """Send the module to the workers as it is now, with what a test has changed in it."""
    from contextlib import contextmanager

    from pyspark import cloudpickle

    @contextmanager
    def sent():
        cloudpickle.register_pickle_by_value(module)
        try:
            yield
        finally:
            cloudpickle.unregister_pickle_by_value(module)

    return sent()


@pytest.mark.parametrize("weak", [False, True])
def test_crowded_anchors_small_blocks_and_colliding_hashes(spark, odd, monkeypatch, weak):
    monkeypatch.setattr(suffixdedup, "PIECE", 200)
    monkeypatch.setattr(suffixdedup, "BATCH", 300)
    monkeypatch.setattr(suffixdedup, "HEAVY", 1)
    monkeypatch.setattr(store, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(mail, "FAN", 4096 if weak else 3)
    monkeypatch.setattr(mail, "HELD", 5000)
    if weak:  # most hashes collide: filter, partitions and anchors' kinds all see few values
        strong = suffixdedup._mix
        monkeypatch.setattr(suffixdedup, "_mix", lambda x: strong(x) >> np.uint64(61))
    with by_value(suffixdedup), by_value(store), by_value(mail):
        assert by_id(suffixdedup.digests(odd)) == brute.suffix_dedup(pairs(odd))


def test_answers_are_not_broadcast(spark, odd, monkeypatch):
    """Answers of a round grow with the bytes of all texts, so none may pass through the driver, however small Spark takes them for."""
    plans, staged = {}, store.staged

    def kept(df, name, folder=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, name, folder)

    monkeypatch.setattr(store, "staged", kept)
    assert by_id(suffixdedup.digests(odd)) == brute.suffix_dedup(pairs(odd))
    for name in ("suffix-r1", "suffix-r2"):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name]


def test_rows_that_share_ids_and_null_ids(spark):
    """Equal texts under one id remove nothing from each other; a null id is larger than any; every row stays a row."""
    t = "".join(random.Random(1).choice("abcdefgh ") for _ in range(90))
    rows = spark.createDataFrame([(5, t), (5, t), (None, t), (None, "x" + t), (9, t[:70]), (3, None)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixdedup.digests(rows).collect())
    assert got == Counter([(5, 90, 0, 0), (5, 90, 0, 0), (None, 90, 90, 1), (None, 91, 90, 1), (9, 70, 70, 1), (3, 0, 0, 0)])
    whole = suffixdedup.without_repeats(rows).collect()
    assert {(r["doc_id"], bytes(r["kept"])) for r in whole} == {(5, t.encode()), (None, b""), (None, b"x"), (9, b""), (3, b"")}
    lines = spark.createDataFrame([(7, "same\nown %d" % i) for i in range(9)] + [(None, " SAME\t\nlast")], "doc_id long, text string")
    got = linededup.digests(lines).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["keep_runs"]) for r in got) == Counter({(7, 2, 1, "0,1,1"): 9, (None, 2, 1, "0,1,1"): 1})
    near = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(rows.limit(3)).collect()}
    assert near == {(5, 5), (None, 5)}


def test_family_of_suffix_arrays():
    rnd = random.Random(2)
    text = np.frombuffer("".join(rnd.choice("ab") for _ in range(4000)).encode() + bytes(60) + b"\xff" * 60, np.uint8)
    starts = np.array([rnd.randrange(len(text) - 50) // 7 * 7 for _ in range(1500)])
    order = np.sort(np.array([rnd.randrange(200) for _ in range(1500)]))
    family, first, got, want = suffixarray.Family(), {}, [], []
    for s in range(0, 1500, 37):
        own = slice(s, s + 37)
        batch = suffixarray.Batch(text, starts[own], order[own])
        plain = [text[i : i + 50].tobytes() for i in starts[own]]
        assert [plain[i] for i in batch.array] == sorted(plain)  # the bytes' own order, zero bytes at the end included
        got += family.earlier(batch, order[own]).tolist()
        for p, d in zip(plain, order[own]):
            first.setdefault(p, d)
        want += [bool(first[p] < d) for p, d in zip(plain, order[own])]
    assert got == want and any(want)
    sizes = [len(b) for b, _ in family.levels]
    assert all(a > b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len({text[i : i + 50].tobytes() for i in starts}) and len(sizes) <= 12


def test_texts_of_megabytes(spark):
    """One text far larger than a block or a slice, through every operator that reads texts."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(4000)]
    big = "\n".join(" ".join(rnd.choices(words, k=12)) for _ in range(45_000))
    docs = spark.createDataFrame([(1, big), (2, big[1000:60_000]), (3, None)], "doc_id long, text string")
    got = by_id(suffixdedup.digests(docs))
    assert got[1][1] == 0 and got[2][1] == 59_000 and got[3][0] == 0
    got = by_id(linededup.digests(docs))
    assert got[1][:2] == (45_000, 0) and got[1][2] == hashlib.sha256(big.encode()).hexdigest()
    media = by_id(webp.digests(docs))
    assert media[1][0] == len(big) and media[1][4] < 0.6 * len(big) and media[1][2] == hashlib.sha256(webp.payload(big.encode())).hexdigest()
    assert by_id(simhash.near_duplicates(docs))[1][0] == f"{simhash.fingerprint(big.encode()):016x}"


def test_line_bitmaps(spark, odd):
    maps, want = by_id(linededup.line_bitmaps(odd)), brute.line_dedup(pairs(odd))
    for d, t in pairs(odd):
        n, keep = maps[d]
        kept = linededup.kept_lines(t.encode(), bytes(keep))
        assert (n, n - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest(), linededup.keep_runs(n, bytes(keep))) == want[d]
    flags = linededup.kept_flags(5, linededup.keep_bitmap(5, [np.array([0, 3], "<u4").tobytes()]))
    assert flags.tolist() == [0, 1, 1, 0, 1] and linededup.keep_runs(5, linededup.keep_bitmap(5, [np.array([0, 3], "<u4").tobytes()])) == "0,1,2,1,1"
    plan = linededup.digests(odd)._jdf.queryExecution().toString()
    assert not any("Exchange" in line and "text" in line for line in plan.split("\n"))


def test_byte_bpe_equals_library(spark, odd):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(OPERATORS["op2"](odd))
    for d, t in pairs(odd):
        ids = lib.encode_ordinary(t)
        assert got[d] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = by_id(byte_bpe.decode(byte_bpe.encode(odd, BPE, P.PATTERN), BPE, P.PATTERN))
    assert {d: bytes(b).decode() for d, (b,) in back.items()} == dict(pairs(odd))


def library(path):
    """A tokenizer of the library as it comes."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [JSON, WORD])
def test_chunked_encoding_equals_library(path):
    enc, lib, rnd = encoder(path), library(path), random.Random(1)
    texts = ["".join(rnd.choice("ab 'sÉ.\nΣ̈aA9½漢!\t") for _ in range(n % 30)) for n in range(4000)]
    marks = ["<|endoftext|>", "<|startoftext|>"]
    texts += [f"{a}{m}{b}{n}{c}" for m in marks for n in [*marks, ""] for a in ("", "a ", "word") for b in ("", " ", "x") for c in ("", " b", "s")]
    texts += ["<|ENDOFTEXT|>", "<|endoftext|", "< |endoftext|>", "hello <|endoftext|> world"]
    for text in texts:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, odd, empty, tmp_path):
    out = str(tmp_path / "a")
    (tmp_path / "a").mkdir()
    token_files.write(odd, JSON, out)
    want, start, lib = {}, 0, library(JSON)
    for d, t in sorted(pairs(odd)):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert by_id(token_files.read(spark, out)) == want
    files = token_files.TokenFiles(out)
    assert (len(files), files.ids) == (len(want), start) and files[0].tolist() == [0]
    (tmp_path / "b").mkdir()
    token_files.write(empty, JSON, str(tmp_path / "b"))
    assert token_files.read(spark, str(tmp_path / "b")).collect() == []


def check_packing(rows, docs):
    """Every id in one piece, windows gapless and powers of two, steps of one tier and of their size."""
    lib = library(WORD)
    by_doc, by_seq, by_step = {}, {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"], r["step_id"]))
    for d, t in docs:
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for start, n, crc, total in sorted(by_doc[d]):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[at : at + n].tobytes()))
            at += n
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, n, _, _ in sorted(parts):
            assert offset == at and n > 0
            at += n
        (tier,), (step,) = {p[2] for p in parts}, {p[3] for p in parts}
        assert at == tier <= 4096 and at & (at - 1) == 0
        by_step.setdefault(step, []).append((tier, sum(n * n for _, n, _, _ in parts)))
    for windows in by_step.values():
        assert len({t for t, _ in windows}) == 1 and sum(t for t, _ in windows) <= packing.STEP
    return by_seq, by_step


def test_packing_places_every_id_once(spark, odd):
    by_seq, _ = check_packing(packing.packed(odd, WORD).collect(), pairs(odd))
    # what the tasks leave is packed together: one cut along binary digits, not one a task
    assert sum(1 for parts in by_seq.values() if parts[0][2] < packing.TIERS[0]) <= 8


def test_packing_steps_are_balanced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(2)
    _, by_step = check_packing(packing.packed(docs, WORD).collect(), pairs(docs))
    full = [sum(c for _, c in w) for w in by_step.values() if len(w) * w[0][0] == packing.STEP and w[0][0] == 4096]
    assert len(full) > 3 and max(full) < 1.3 * min(full)
    costs = [5, 1, 9, 7, 3, 3, 8]
    steps = packing.balanced(costs, 3)
    assert Counter(steps) == {0: 3, 1: 3, 2: 1} and packing.balanced([], 4) == []


def test_masks_cover_every_difference():
    found, rnd = simhash.masks(), random.Random(0)
    assert len(found) == 31
    for _ in range(20000):
        diff = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(m & diff == 0 for m in found)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    fps = [0b1, 0b11, 0b111, 0b11111111, 0b1111111, 1 << 40, (1 << 40) | 0xFF00, 7 << 50] + [1 << i for i in range(20, 30)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r["node"]: r["component"] for r in components.connected(edges).collect()}
    assert len(set(got.values())) == 1 and set(got) == set(fps) - {(1 << 40) | 0xFF00}


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [tuple(sorted(rnd.sample(range(200, 260), 2))) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_language_id(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.identify(docs, MULTI).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.98
    und = {r["doc_id"] for r in langid.identify(odd, MULTI).collect() if r["lang_pred"] == "und"}
    assert und == {d for d, t in pairs(odd) if not any(c.isalpha() for c in t)}


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "bab"]
    prob = np.array([[0.3], [0.2], [0.1], [0.25], [0.15], [0.0]])
    model = langid.Model(["x"], pieces, prob, np.zeros(1))

    def total(w):
        return 1.0 if not w else sum(prob[i][0] * total(w[len(p) :]) for i, p in enumerate(pieces) if w.startswith(p))

    for w in ("a", "ab", "abab", "babab", "bbaabab"):
        assert np.isclose(model.word_scores([w])[0, 0], np.log(total(w)))


def test_language_id_equals_plain_version(spark, odd):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    long = [(10_000 + i, "donaudampfschifffahrtsgesellschaft " * 3 + "x" * 60, "de") for i in range(3)]
    docs = rows.unionByName(spark.createDataFrame(long, rows.schema)).unionByName(odd.select("doc_id", "text", "lang").filter("doc_id < 90").withColumn("doc_id", F.col("doc_id") + 20_000))
    data = docs.collect()
    known = [(r["text"], r["lang"]) for r in data if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    plain = brute.language_model(known, langid.vocabulary(MULTI))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, MULTI).collect()}
    for r in data[:40] + data[-33:]:
        lang, score = plain(r["text"])
        assert got[r["doc_id"]][0] == lang and abs(got[r["doc_id"]][1] - score) < 2e-3, (r["text"], got[r["doc_id"]], lang, score)


def test_language_words_are_shared_out(spark):
    """A language with few documents keeps its words beside one with very many; nothing limits the number of languages."""
    rows = [(i, f"alpha{i % 700} beta{i % 900} gamma", "big") for i in range(2000)] + [(5000 + i, "zorp blick quaxel", "small") for i in range(8)]
    rows += [(6000 + i, f"word{i}uv thing{i}yz " * 3, f"l{i:03d}") for i in range(260)] * 2
    docs = spark.createDataFrame([(i * 7 + k, t, x) for k, (i, t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    out = {r["text"]: r["lang_pred"] for r in langid.identify(docs, MULTI).join(docs.select("doc_id", "text"), "doc_id").collect()}
    assert out["zorp blick quaxel"] == "small" and len(set(out.values())) > 200


def test_toxicity_equals_plain_version(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    own = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("o", F.xxhash64("doc_id", F.lit(3))).orderBy("o", "doc_id").collect()
    train = [(texts[r["doc_id"]], r["toxic"]) for r in own if r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    some = sorted(texts)[::5]
    for d, want in zip(some, brute.toxicity(train, [texts[d] for d in some]), strict=True):
        assert abs(got[d] - want) < 1e-9
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "one two"), (4, "word " * 300_000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in toxicity.classify(docs.unionByName(odd.filter("false")), labels).limit(1).collect()}
    assert rows
    scored = {r["doc_id"]: r for r in toxicity.score(odd, toxicity.learn(docs, labels)).collect()}
    assert scored[1]["score"] == scored[2]["score"] and scored[None]["held_out"] and all(0 <= r["score"] <= 1 for r in scored.values())


def test_toxicity(spark, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity.classify(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    bad, good = ([r["score"] for r in rows if truth[r["doc_id"]] == x] for x in (1, 0))
    assert np.mean([x > y for x in bad for y in good]) > 0.95 and np.mean([y >= 0.5 for y in good]) < 0.01
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.classify(odd, none).collect()} == {0.0}
    assert toxicity.classify(empty, labels).collect() == []


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(range(len(x)) if ids is None else ids, x)], "vec_id long, embedding array<double>")


def recall(table, least_rows=20):
    """Mean share of the true nearest found, shares of parts visited and of rows scored; every query must get its 20."""
    rows = [(r["vec_id"], np.array(r["v"])) for r in ann.valid(table).collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r["query_id"], []).append(r)
    hits, visited = [], []
    for q in np.unique(ids[ids % 20 == 0]):
        own = sorted(got[q], key=lambda r: r["rank"])
        s = x @ x[np.nonzero(ids == q)[0][0]]
        s[ids == q] = -np.inf
        want = np.sort(s)[::-1][: min(least_rows, int((s > -np.inf).sum()))]
        assert [r["rank"] for r in own] == list(range(1, len(want) + 1)) and len({r["vec_id"] for r in own}) == len(own)
        assert all(np.isclose(r["score"], s[np.nonzero(ids == r["vec_id"])[0]].max()) for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        hits.append(np.mean([r["score"] >= want[-1] - 1e-12 for r in own]))
        visited.append(own[0]["visited"] / own[0]["parts"])
    return np.mean(hits), np.mean(visited)


def test_nearest_neighbours(spark):
    """The test table's vectors have no structure: even so not every part is visited."""
    found, visited = recall(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    assert found >= 0.9 and visited < 0.95


def test_nearest_neighbours_in_clusters(spark):
    rnd = np.random.default_rng(0)
    c = rnd.normal(size=(40, 24))
    x = np.concatenate([c[i] + 0.2 * rnd.normal(size=(100, 24)) for i in range(40)])
    found, visited = recall(vectors(spark, rnd.permutation(x / np.linalg.norm(x, axis=1)[:, None])))
    assert found >= 0.9 and visited < 0.2
    c = rnd.normal(size=(7, 24))
    skewed = np.concatenate([c[0] + 0.1 * rnd.normal(size=(2000, 24)), *(c[i] + 0.1 * rnd.normal(size=(12, 24)) for i in range(1, 7))])
    found, visited = recall(vectors(spark, rnd.permutation(skewed)))
    assert found >= 0.9 and visited < 0.9
    norms = np.concatenate([s * (c[i] + 0.2 * rnd.normal(size=(500, 24))) for i, s in enumerate((1, 2, 4, 0.5))])
    found, visited = recall(vectors(spark, rnd.permutation(norms)))
    assert found >= 0.9 and visited < 0.6


def test_parts_are_balanced_and_grow(spark):
    rnd = np.random.default_rng(4)
    parts = []
    for n in (1000, 6000):
        v = vectors(spark, rnd.normal(size=(n, 16))).withColumnRenamed("embedding", "v")
        tree = ann.fit(v, n)
        size = np.bincount(tree.place(np.array([r["v"] for r in v.collect()])), minlength=tree.parts)
        assert size.max() <= 1.5 * n / tree.parts
        parts.append(tree.parts)
    assert parts[1] > parts[0] > 3


def test_repeated_ids_and_copies_of_vectors(spark):
    """A query whose parts hold little but its own id is asked again everywhere; copies fill a part but lose nothing."""
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(600, 8))
    table = vectors(spark, np.concatenate([np.tile(x[:1], (300, 1)), x, np.tile(x[1:2], (200, 1))]), [0] * 300 + list(range(600)) + list(range(1000, 1200)))
    found, _ = recall(table)
    assert found >= 0.9
    few = vectors(spark, x[:5], range(0, 100, 20))
    assert Counter(r["query_id"] for r in ann.search(few).collect()) == dict.fromkeys(range(0, 100, 20), 4)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0])]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_webp_round_trip(odd):
    for d, n, size, sha, crc, *_ in (tuple(r) for r in webp.digests(odd).collect()):
        raw = dict(pairs(odd))[d].encode()
        back = webp.payload(raw)
        assert (n, size, sha, crc) == (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]))
        assert size % 192 == 0 and size > 0
        media, feature = _[0], _[2]
        assert media > 0 and feature.startswith(f"192x{size // 192};mean={np.frombuffer(back, np.uint8).mean():.6f};")


def _code(b, lengths):
    """Write a normal prefix code whose lengths are given, without run symbols."""
    b.write(0, 1)
    b.write(15, 4)
    for s in codec.CODE_LENGTH_ORDER:
        b.write(0 if s > 15 else 4, 3)
    b.write(0, 1)
    for n in lengths:
        b.write(int(f"{n:04b}"[::-1], 2), 4)


def _simple(b, *symbols):
    b.write(1, 1)
    b.write(len(symbols) - 1, 1)
    b.write(1, 1)
    for s in symbols:
        b.write(s, 8)


def test_webp_references_cache_and_transforms():
    b = codec.Bits()
    for v, n in ((4 - 1, 14), (2 - 1, 14), (0, 1), (0, 3), (1, 1), (2, 2), (0, 1)):  # 4x2, subtract-green
        b.write(v, n)
    b.write(1, 1)
    b.write(1, 4)  # a cache of two colours
    b.write(0, 1)
    lengths = [0] * 282
    for s, n in ((10, 2), (256 + 2, 2), (280, 2), (281, 2)):  # green 10; copy 3; both cache entries
        lengths[s] = n
    _code(b, lengths)
    for values in ((1,), (2,), (255,), (1,)):  # red, blue, alpha; distance symbol 1: code 2, the pixel to the left
        _simple(b, *values)
    first = 255 << 24 | 1 << 16 | 10 << 8 | 2
    at = (codec.CACHE_MULTIPLIER * first & 0xFFFFFFFF) >> 31
    for code in (0, 1, 2 + at, 1):  # literal, copy of 3, cache, copy of 3
        b.write(int(f"{code:02b}"[::-1], 2), 2)
    data = codec.container(b.value.to_bytes((b.size + 7) // 8, "little"))
    assert codec.decode(data).reshape(-1, 4).tolist() == [[255, 11, 10, 12]] * 8

    b = codec.Bits()
    for v, n in ((5 - 1, 14), (1 - 1, 14), (0, 1), (0, 3), (1, 1), (3, 2), (1, 8), (0, 1)):  # 5x1, palette of two, packed eight a pixel
        b.write(v, n)
    for values in ((7, 1), (8,), (9,), (255, 0), (0,)):  # table: (255, 8, 7, 9), then the difference (0, 8, 1, 9)
        _simple(b, *values)
    # two-symbol codes number the smaller symbol first
    for bit in (1, 1, 0, 0):
        b.write(bit, 1)
    for v, n in ((0, 1), (0, 1), (0, 1)):
        b.write(v, n)
    for values in ((0b10110,), (0,), (0,), (255,), (0,)):
        _simple(b, *values)
    data = codec.container(b.value.to_bytes((b.size + 7) // 8 + 1, "little"))
    one, two = [255, 8, 7, 9], [255, 16, 8, 18]
    assert codec.decode(data)[0].tolist() == [one, two, two, one, two]


def predictions(left, top, right, corner):
    """The fourteen guesses of a pixel from its neighbours (left, above, above right, above left), channel by channel."""
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    guess = [x + t - c for x, t, c in zip(left, top, corner)]
    far = lambda p: sum(abs(g - x) for g, x in zip(guess, p))
    half = mean(left, top)
    return [
        [255, 0, 0, 0], left, top, right, corner, mean(mean(left, right), top), mean(left, corner), mean(left, top), mean(corner, top), mean(top, right),
        mean(mean(left, corner), mean(top, right)), left if far(left) < far(top) else top, [clamp(g) for g in guess],
        [clamp(h + (abs(h - c) // 2 if h >= c else -(abs(h - c) // 2))) for h, c in zip(half, corner)],
    ]


def test_files_read_in_step_equal_files_read_alone():
    """Streams with codes for all channels, references and distances near and far, against the tokens they were made of."""
    rnd = random.Random(6)
    files, want = [], []
    for _ in range(30):
        w, h = rnd.randint(1, 20), rnd.randint(1, 12)
        b = codec.Bits()
        for v, n in ((w - 1, 14), (h - 1, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
            b.write(v, n)
        greens = sorted(rnd.sample(range(256), 14)) + [256, 256 + 4]
        _code(b, [4 if i in greens else 0 for i in range(280)])
        reds = sorted(rnd.sample(range(256), 4))
        _code(b, [2 if i in reds else 0 for i in range(256)])
        blues, alphas = sorted(rnd.sample(range(256), 2)), sorted(rnd.sample(range(256), 2))
        _simple(b, *blues)
        _simple(b, *alphas)
        far = [0, 1, 4, 14]  # distance codes 1, 2, 5 or 6, and 129 to 192
        _code(b, [2 if i in far else 0 for i in range(40)])
        out = []
        flip = lambda v, n: int(f"{v:0{n}b}"[::-1], 2)
        while len(out) < w * h:
            g = rnd.randrange(16)
            extra, length = rnd.randrange(2), 0
            if g >= 14:
                length = 1 if g == 14 else 5 + extra
                d = rnd.randrange(4)
                more = rnd.randrange(2) if d == 2 else rnd.randrange(64) if d == 3 else 0
                near = [1, 2, 5 + more, 129 + more][d]
                places = {1: w, 2: 1, 5: 2 * w, 6: 2}
                distance = max(1, places[near]) if near in places else near - 120
                if distance > len(out) or len(out) + length > w * h:
                    continue
            b.write(flip(g, 4), 4)
            if length:
                b.write(extra if g == 15 else 0, 1 if g == 15 else 0)
                b.write(flip(d, 2), 2)
                b.write(more, {2: 1, 3: 6}.get(d, 0))
                for _ in range(length):
                    out.append(out[-distance])
            else:
                r, u, a = rnd.randrange(4), rnd.randrange(2), rnd.randrange(2)
                b.write(flip(r, 2), 2)
                b.write(u, 1)
                b.write(a, 1)
                out.append([alphas[a], reds[r], greens[g], blues[u]])
        files.append(codec.container(b.value.to_bytes((b.size + 7) // 8, "little")))
        want.append(np.array(out, np.uint8).reshape(h, w, 4))
    for f, one, px in zip(files, codec.decode_many(files), want, strict=True):
        assert (one == px).all() and (codec.decode(f) == px).all()
    with pytest.raises(ValueError):
        codec.decode_many([files[0], files[1][:-12]])


def test_writer_uses_what_the_format_has():
    """Prose shrinks by codes, copies by references, few values by bundled pixels; all of it reads back."""
    rnd = np.random.default_rng(1)
    prose = webp.payload(" ".join("the quick brown fox jumps over a lazy dog".split()[i] for i in rnd.integers(0, 9, 900)).encode())
    noise = rnd.integers(0, 256, 192 * 30, dtype=np.uint8).tobytes()
    few = bytes(rnd.integers(0, 3, 192 * 20, dtype=np.uint8))
    for data, most in ((prose, 0.5), (noise[:1920] * 3, 0.75), (few, 0.3), (noise, 1.3), (b" " * 192, 1.0)):
        media = webp.to_media([data])[0]
        assert len(media) <= most * len(data) and webp.from_media([media])[0].tobytes() == data
        one = np.concatenate([codec.decode(f)[:, :, 1:] for f in webp.files_of(media)])
        assert (one == np.frombuffer(data, np.uint8).reshape(-1, 192, 1)).all()  # gray in all three channels
    lengths = codec.code_lengths([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597], 7)
    assert max(lengths) <= 7 and sum(2.0**-n for n in lengths) == 1


def test_predictors_and_cross_colour_are_inverted():
    rnd = np.random.default_rng(2)
    block = rnd.integers(0, 1 << 32, (2, 2), dtype=np.uint32)
    h, w = 5, 7
    image = rnd.integers(0, 256, (h, w, 4))
    image[2:] = image[1] // 3 * 3 + rnd.integers(0, 3, (h - 2, w, 4))  # near neighbours too
    for mode in range(14):
        coded = np.zeros((h, w), np.uint32)
        for y in range(h):
            for x in range(w):
                at = lambda j, i: image[j, i].tolist()  # noqa: E731, B023
                if not y:
                    guess = at(0, x - 1) if x else [255, 0, 0, 0]
                elif not x:
                    guess = at(y - 1, 0)
                else:  # past the right end the row's own first pixel follows
                    guess = predictions(at(y, x - 1), at(y - 1, x), at(y - 1, x + 1) if x + 1 < w else at(y, 0), at(y - 1, x - 1))[mode]
                coded[y, x] = int.from_bytes(bytes((int(a) - g) & 255 for a, g in zip(image[y, x], guess)), "big")
        own = np.full((2, 2), mode << 8, np.uint32)
        got = codec._unpredict(coded.ravel(), w, h, own, 2)
        assert got.astype(">u4").tobytes() == image.astype(np.uint8).tobytes(), mode
    px = rnd.integers(0, 1 << 32, 35, dtype=np.uint32)
    signed = lambda v: (v & 255) - 256 * ((v & 255) > 127)
    coded = []
    for i, p in enumerate(px.tolist()):
        e = int(block[i // 7 >> 2, i % 7 >> 2])
        r, g, b = p >> 16 & 255, p >> 8 & 255, p & 255
        nb = b - (signed(e >> 8) * signed(g) >> 5) - (signed(e >> 16) * signed(r) >> 5)
        nr = r - (signed(e) * signed(g) >> 5)
        coded.append(p & 0xFF00FF00 | (nr & 255) << 16 | nb & 255)
    assert (codec._uncross(np.array(coded, np.uint32), 7, 5, block, 2) == px).all()


def test_lines_equal_sql(spark):
    from oracle import compare

    for name, sql in queries.oracle_sql().items():
        assert compare(spark, queries.queries()[name], sql, SF) > 0


CLASHES = ["_doc", "_id", "_text", "_h", "_key", "_dropped", "_kept", "kept", "n_lines", "n_dropped", "blk", "row", "path", "h", "fp", "pos", "image"]


def test_pipeline_stages_on_odd_tables(spark):
    """Shared ids of different texts, null ids and texts, empty tables, and columns of any name, whose values come back unchanged."""
    import corpus_pipeline as cp

    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    passage = text(30)
    texts = [text(40), text(40), None, "", "12 34", f"{text(20)} {passage}", f"{passage} {text(25)}", f"common line\n{text(30)}"]
    rows = [(5, texts[0]), (5, texts[1]), (None, text(30)), (None, text(33)), (None, None), (6, None), (7, ""), (8, "12 34"), (5, texts[5]), (12, texts[6]), (13, texts[0])]
    rows += [(20 + i, f"Common LINE {'x' if i < 0 else ''}\n{text(30)}") for i in range(11)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHES)])
    data = [(d, t, None if t is None else len(t), *(f"{c}{i}" for c in CLASHES)) for i, (d, t) in enumerate(rows)]
    docs = spark.createDataFrame(data, schema).repartition(3)
    by_row = {r[3]: r for r in data}

    def check(out):
        assert out.schema.simpleString() == docs.schema.simpleString()
        got = {r[CLASHES[0]]: r for r in out.collect()}
        for tag, r in got.items():
            assert tuple(r)[3:] == by_row[tag][3:] and r["doc_id"] == by_row[tag][0] and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        return {int(tag.removeprefix("_doc")): r["text"] for tag, r in got.items()}

    letters = {i for i, (_, t) in enumerate(rows) if t and any(map(str.isalpha, t))}
    assert set(check(cp.language_id(spark, docs.withColumn("lang", F.lit("aa")), SF).drop("lang"))) == letters
    lines = check(cp.line_dedup(spark, docs, SF))
    assert lines == {i: t if i < 11 or t is None else t.split("\n")[1] for i, (_, t) in enumerate(rows)}
    near = check(cp.near_dedup(spark, docs, SF))
    # null, empty and wordless texts are one group each of fingerprint; 13 repeats the text of 5
    assert near == {i: t for i, (_, t) in enumerate(rows) if i not in (4, 6, 10)} or near == {i: t for i, (_, t) in enumerate(rows) if i not in (4, 5, 10)}
    cut = check(cp.suffix_dedup(spark, docs, SF))
    assert cut[9] is not None and passage not in cut[9] and cut[10] == "" and {i: t for i, t in cut.items() if i not in (9, 10) and i < 11} == {i: t for i, (_, t) in enumerate(rows) if i not in (9, 10) and i < 11}
    assert sum(r["length"] for r in cp.pack(spark, docs, SF).filter("doc_id = 5").collect()) > 0 and cp.pack(spark, docs, SF).filter("start = 0").count() == len(rows)
    none = docs.limit(0)
    for name, stage in cp.STAGES[1:]:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
    assert cp.language_id(spark, none.withColumn("lang", F.lit("aa")), SF).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = cp.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.filter("text rlike '[a-zA-Z]'").count()
    near = cp.near_dedup(spark, docs, SF)
    want = {c for _, c in brute.simhash(pairs(docs)).values()}
    assert {r["doc_id"] for r in near.collect()} == want
    cut = by_id(cp.suffix_dedup(spark, docs, SF).select("doc_id", "text"))
    plain = brute.suffix_dedup(pairs(docs))
    same = {d: t for d, t in pairs(docs) if plain[d][1] == 0}
    assert all(cut[d][0] == t for d, t in same.items()) and len(cut) == docs.count()
    lines = by_id(cp.line_dedup(spark, docs, SF).select("doc_id", "text"))
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, (t,) in lines.items()} == {d: v[2] for d, v in brute.line_dedup(pairs(docs)).items()}
    assert cp.run(spark, SF).count() > 0
