"""Every operator against brute force on small, awkward tables: nulls, empty and long texts, ties,
repeated rows, clashing column names, empty tables."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import components, decontaminate, hyperminhash, langid, line_dedup, mips, orc_tokens, packing, substring, token_scan, toolcalls
from tillroll.llm.queries import vocabulary
from tillroll.llm.ship import ship
from tillroll.llm.tokens import CachedEncoder
from tillroll.sources.stage import scratch_path

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts():
    rng = random.Random(3)
    vocab = ["the", "of", "Étude", "it's", "don't", "x1", "2024", "naïve", "...", "über", "Σίσυφος", "漢字", "é"] + [f"w{i}" for i in range(60)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = make(40)
    base = make(120)
    out = [None, "", " ", "\n", "one", "one two", "ONE two", "a a " * 40, make(9000), "95", "it is 95 now"]
    out += [make(rng.randrange(1, 90)) for _ in range(30)]
    out += [make(15) + " " + passage + " " + make(15) for _ in range(6)]
    out += [base] * 4 + [base.replace("w7 ", "changed ", 1), base + " tail of it", base.upper()]
    out += ["Shared line of text\n" + make(5) + "\n shared LINE of text \nshort\n" for _ in range(4)]
    out += ["  two  spaces\t\ttab\r\nline \n\n end ", "<|endoftext|> inside", "é" * 300, "line\n" * 50]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, None if i % 9 == 0 else "en", "src", i, 0.5, True) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, score double, kept boolean").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def words(t, pattern=SPACED, lower=True):
    b = (t or "").encode()
    return pattern.findall(b.translate(LOW) if lower else b)


@pytest.mark.parametrize("kind,name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_cached_encoder_equals_the_library(kind, name, monkeypatch):
    monkeypatch.setattr("tillroll.llm.tokens.CHUNK_CHARS", 4000)
    enc = CachedEncoder(vocabulary(name), kind)
    ids, lens = enc.encode(texts())
    at = 0
    for t, n in zip(texts(), lens.tolist()):
        assert ids[at:at + n].tolist() == enc.tok.encode(t or "", add_special_tokens=False).ids, t
        at += n
    assert at == len(ids)


def _ids(name, end):
    tok = CachedEncoder(vocabulary(name), "word").tok
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts()]


def test_op1_separator_scan(spark, docs, empty):
    folder = scratch_path(spark, "t1")
    order = token_scan.write(docs, folder, vocabulary("word_bpe_49k.json"))
    want = sorted((i, len(x) - 1) for i, x in enumerate(_ids("word_bpe_49k.json", 0)))
    for block in (7, 1 << 20):  # documents over many blocks, and many documents in a block
        assert got(token_scan.token_counts(order, folder, block_ids=block), "doc_id", "n_tokens") == sorted(want, key=repr)
    assert token_scan.token_counts(token_scan.write(empty, folder + "-e", vocabulary("word_bpe_49k.json")), folder).count() == 0


def test_op1_cut_off_document(spark, tmp_path):
    np.array([5, 6, 9, 7, 9, 9, 1, 2], "<u2").tofile(tmp_path / "a.u16")
    found = token_scan.scan(token_scan.files_of(spark, str(tmp_path)), str(tmp_path), end_id=9, block_ids=3)
    assert got(found, "ordinal", "start", "n_tokens", "ended") == [(0, 0, 2, True), (1, 3, 1, True), (2, 5, 0, True), (3, 6, 2, False)]


def test_op2_orc(spark, docs, empty):
    path, at, want = scratch_path(spark, "t2"), 0, []
    orc_tokens.write(docs, path, vocabulary("word_bpe_49k.json"))
    all_ids = _ids("word_bpe_49k.json", 1)
    for i, x in enumerate(all_ids):
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got(orc_tokens.digests(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert [r["ids"] for r in orc_tokens.lookup(spark, path, [8]).collect()] == [all_ids[8].tolist()]
    orc_tokens.write(empty, path + "-e", vocabulary("word_bpe_49k.json"))
    assert orc_tokens.digests(spark, path + "-e").count() == 0


def test_op3_language(spark, docs, empty):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog of the house", "en"), ("der Hund und die Katze im Haus", "de"), ("le chat et le chien de la maison", "fr")] * 30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    told = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(
        [(0, "the house and the cat"), (1, "die Katze und der Hund"), (2, "la maison et le chat"), (3, None), (4, "12 !?"), (5, "ქართული ენა არის ძველი ენა " * 20)], "doc_id long, text string"), model).collect()}
    assert [told[i]["lang_pred"] for i in range(5)] == ["en", "de", "fr", "und", "und"]
    assert [told[i]["rejected"] for i in range(6)] == [False, False, False, True, True, True]
    assert all(0 <= r["score"] <= 1 for r in told.values())
    assert langid.predict(docs, model).columns.count("score") == 1 and langid.predict(docs, model).count() == docs.count()
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def test_op4_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "f", '{"z": 1, "q": "x"}', ["b"]), (1, "b", 1, "f", '{"q": "y"}', None), (1, "c", 2, "g", "{}", []), (1, "d", 3, "f", "[1]", ["gone"]),
        (2, "a", 0, "f", '{"q": 5}', ["b"]), (2, "b", 1, "f", '{"q": "y"}', ["a"]), (2, "b", 2, "f", '{"q": "late"}', []), (None, "x", 0, "f", "{}", []), (3, "a", 0, "f", None, None),
    ], "conv_id long, call_id string, pos long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "a", 5, "ok"), (1, "b", 6, "one"), (1, "b", 7, "two"), (9, "a", 0, "lost")], "conv_id long, call_id string, pos long, content string")
    schemas = spark.createDataFrame([("f", ["q"], {"q": "STRING", "z": "BIGINT"})], "name string, required array<string>, types map<string, string>")
    out = {(r["conv_id"], r["call_id"]): r for r in toolcalls.link(calls, results, schemas).collect()}
    assert [out[1, x]["turn"] for x in "abcd"] == [4, 1, 2, 3] or out[1, "a"]["turn"] > out[1, "b"]["turn"]
    assert sorted(out[1, x]["turn"] for x in "abcd") == [1, 2, 3, 4]
    assert out[1, "a"]["valid"] and json.loads(out[1, "a"]["record"]) == {"arguments": {"q": "x", "z": 1}, "depends_on": ["b"], "id": "a", "name": "f", "result": "ok"}
    assert out[1, "a"]["record"].startswith('{"arguments":{"q":"x","z":1}')
    assert out[1, "b"]["errors"] == ["repeated result"]
    assert out[1, "c"]["errors"] == ["unknown tool", "no result"]
    assert out[1, "d"]["errors"] == ["arguments are no JSON object", "no result", "missing dependency gone"]
    assert out[2, "a"]["errors"] == ["wrong type q", "no result", "dependency cycle"]
    assert "repeated call id" in out[2, "b"]["errors"] and out[3, "a"]["errors"][0] == "arguments are no JSON object"
    assert len(out) == 7 and toolcalls.orphans(calls, results).count() == 1
    assert toolcalls.link(calls.where("false"), results, schemas).count() == 0


def test_op5_top_k(spark, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8)) * rng.uniform(0.1, 3, (400, 1))
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(v)] + [(500, rows_) for rows_ in ([0.0] * 8,)]
    rows += [(600 + i, rows[10][1]) for i in range(7)] + [(700, None), (701, [1.0] * 7 + [None]), (702, [float("nan")] * 8), (750, [float("inf")] * 8), (800, [1.0, 2.0]), (850, [2.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ints = {i: np.floor(256 * np.array(x)).astype(np.int64) for i, x in rows if x is not None and None not in x and np.isfinite(x).all()}
    want = []
    for q in ints:
        if q % 50 == 0:
            best = sorted((-int(ints[q] @ c), i) for i, c in ints.items() if i != q and len(c) == len(ints[q]))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for cosine in (0.2, 2.0):
        monkeypatch.setattr(mips, "COSINE", cosine)
        monkeypatch.setattr(mips, "BUCKET", 32)
        assert got(mips.top_k(table, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert mips.top_k(table.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_op6_decontamination(spark, docs, empty):
    t = texts()
    items = [(1, " ".join(t[8].split()[100:125])), (2, "95"), (3, None), (4, "!!"), (10, t[45]), (10, t[45]), (None, "one two"), (5, "never seen anywhere at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, x in items:
        w = words(x, ALNUM)
        if i is not None:
            for k in range(max(len(w) - 9, 1) if w else 0):
                windows.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    want = []
    for d, x in enumerate(t):
        w, hit, found = words(x, ALNUM), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert got(decontaminate.digests(decontaminate.mark(docs, bench)), *columns) == sorted(want, key=repr)
    assert decontaminate.mark(empty, bench).count() == 0
    assert decontaminate.mark(docs, bench.where("false")).where("size(hit_items) > 0").count() == 0


def test_op6_many_indexes(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(texts()[11:30])], "item_id long, text string")
    whole = got(decontaminate.digests(decontaminate.mark(docs, bench)), "doc_id", "n_hit", "items_sha256")
    monkeypatch.setattr(decontaminate, "MAX_INDEX_WORDS", 1500)
    assert got(decontaminate.digests(decontaminate.mark(docs, bench)), "doc_id", "n_hit", "items_sha256") == whole


@pytest.mark.parametrize("hot", [False, True])
def test_op7_repeated_passages(docs, empty, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(substring, "HOT", 1)
    first, want = {}, []
    for d, x in enumerate(texts()):
        w = words(x, SPACED, False)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first.setdefault(tuple(w[k:k + 20]), (d, k)) != (d, k):
                gone[k:k + 20] = [True] * 20
        want.append((d, len(w), sum(gone), b" ".join(a for a, g in zip(w, gone) if not g).decode()))
    assert got(substring.dedup(docs), "doc_id", "n_words", "n_removed", "kept") == sorted(want, key=repr)
    assert got(substring.dedup(docs.unionByName(docs)), "doc_id", "n_words", "n_removed", "kept") == sorted(want, key=repr)
    assert substring.dedup(empty).count() == 0


def test_op8_lines(docs, empty):
    key = lambda line: line.encode().translate(LOW).strip(b" \t\n\x0b\x0c\r").decode()
    first, want = {}, []
    for d, x in enumerate(texts()):
        for line in (x or "").split("\n"):
            first.setdefault(key(line), d)
    for d, x in enumerate(texts()):
        lines = (x or "").split("\n")
        keep = [s for s in lines if len(key(s)) < 10 or first[key(s)] == d]
        want.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    for batches in (1, 5):
        out = line_dedup.dedup(docs, batches=batches).withColumn("text", F.coalesce("text", F.lit("")))
        assert got(out, "doc_id", "n_lines", "n_dropped", "text") == sorted(want, key=repr)
    assert line_dedup.dedup(docs.unionByName(docs)).where("n_dropped > 0").count() == 2 * sum(w[2] > 0 for w in want)
    assert line_dedup.dedup(empty).count() == 0


def test_op9_packing(docs, empty):
    tok = CachedEncoder(vocabulary("byte_bpe_50k.json"), "byte").tok
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts()]
    rows = packing.pack(packing.cut(docs, vocabulary("byte_bpe_50k.json"))).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts, size in [(by_doc[d], len(ids[d])) for d in range(len(ids))] + [(p, None) for p in by_seq.values()]:
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == size if size else at <= 1024
    assert sorted(by_seq) == list(range(len(by_seq))) and len(by_seq) == -(-sum(map(len, ids)) // 1024)
    assert packing.pack(packing.cut(empty, vocabulary("byte_bpe_50k.json"))).count() == 0


def test_op9_fill_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(60):
        counts, room = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}, rng.randrange(1, 60)
        reach = {0}
        for x, c in counts.items():
            reach = {r + x * k for r in reach for k in range(c + 1)}
        found = packing.fill(counts, room)
        assert all(c <= counts[x] for x, c in found.items()) and sum(x * c for x, c in found.items()) == max(r for r in reach if r <= room)


@pytest.mark.parametrize("k", [2, 5])
def test_op10_near_duplicates(docs, empty, k):
    sets = []
    for x in texts():
        w = words(x)
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    label[a] = label[b] = min(label[a], label[b])
    want = [(d, len(s), label[d], label[d] == d) for d, s in enumerate(sets)]
    assert got(hyperminhash.group(docs, k=k), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    assert got(hyperminhash.group(docs.unionByName(docs), k=k), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    assert hyperminhash.group(empty, k=k).count() == 0


def test_op10_estimate_and_components(spark):
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 4000, np.uint64)
    for share in (0.5, 0.8, 0.95):
        a, b = pool[:2000], np.concatenate([pool[:int(2000 * share)], pool[2000:4000 - int(2000 * share)]])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        regs = hyperminhash.registers([np.sort(a), np.sort(b)])
        est = hyperminhash.estimate(regs[:1], regs[1:], np.array([2000]), np.array([len(b)]))[0]
        assert abs(est - true) < 0.15
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 150), (None, 3)], "a long, b long")
    assert got(components.components(chain), "node", "component") == sorted([(i, 0) for i in range(1, 41)] + [(200, 150)], key=repr)
