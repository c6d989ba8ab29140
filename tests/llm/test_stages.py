"""Whole outputs of the pipeline's stages against brute force on small tables."""

import re

import corpus_pipeline
from tillroll.llm.ship import ship

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    ship(spark)
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in texts], SCHEMA).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def key(line):
    return line.encode().translate(LOW).strip(b" \t\n\x0b\x0c\r").decode()


def lines_brute(docs):
    """The line stage by its meaning, document by document in ascending doc_id."""
    out, seen, whole = [], set(), set()
    for i, t, lang, source, _ in sorted(docs):
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or key(x) not in seen]
        copy = tuple(map(key, lines)) in whole
        seen |= {key(x) for x in lines}
        whole.add(tuple(map(key, lines)))
        left = "\n".join(keep)
        if len(keep) == len(lines):
            out.append((i, t, lang, source, len(t or "")))
        elif key(left) and not (copy and all(len(key(x)) < 10 for x in keep)):
            out.append((i, left, lang, source, len(left)))
    return sorted(out, key=repr)


LINES = [
    (1, "A first document of its own\nAll rights reserved.\nend"),
    (2, "A.\nAll rights reserved."),  # clean, short line beside a shared one
    (3, "Was orer.\n  ALL rights reserved.  "),
    (4, "\n".join(f"l {n}" for n in range(58)) + "\nAll rights reserved.\nA first document of its own"),
    (5, "A first document of its own\nAll rights reserved.\nend"),  # a copy with a short line left
    (6, " a first DOCUMENT of its own\nall rights reserved.\nEND "),  # the same in other case and blanks
    (7, "All rights reserved.\nend\nA first document of its own"),  # the same lines in another order: no copy
    (8, "All rights reserved.\n \n\t"),  # no word left
    (9, "All rights reserved."),
    (10, "short\nlines"), (11, "short\nlines"),  # lost no line
    (12, "A.\nAll rights reserved."), (13, "A.\n\nAll rights reserved."),
    (14, "A line that stands here only\nend\nAll rights reserved."), (15, "A line that stands here only\nend\nAll rights reserved."),
]


def test_line_stage_keeps_clean_remainders(spark):
    docs = table(spark, LINES)
    want = lines_brute([tuple(r) for r in docs.collect()])
    assert [r[0] for r in sorted(want)] == [1, 2, 3, 4, 7, 10, 11, 13, 14]
    assert rows(corpus_pipeline.line_dedupe(spark, docs, "")) == want


def found(words, window):
    return any(tuple(words[k:k + len(window)]) == window for k in range(len(words) - len(window) + 1))


def benchmark_brute(docs, items):
    """The decontamination stage by its meaning: which documents hold a window that tells."""
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOW))
    windows = set()
    for i, t in items:
        w = words(t)
        windows |= {tuple(w[k:k + 10]) for k in range(max(len(w) - 9, 1))} if i is not None and w else set()
    held = [{x for x in windows if found(words(d[1]), x)} for d in docs]
    often = {x: sum(x in h for h in held) for x in windows}
    common = {x for x in windows if len(x) < 4 and often[x] >= 10 and 1000 * often[x] > len(docs)}
    return sorted((d for d, h in zip(docs, held) if h <= common), key=repr)


ITEMS = [
    (1, "95"), (2, "In which year did the old mill burn down?"),  # nine words
    (3, "rare word here"), (4, "of the same"), (5, "zyx"), (5, "95"), (6, "one two three four five six seven eight nine ten eleven"),
    (7, "four such words here"), (8, "twice"), (None, "plain"), (9, "!"), (10, "nowhere seen"),
]


def planted():
    out = [(i, f"plain text {i} of the same kind" + (" 95" if i % 2 else "")) for i in range(40)]
    out += [(100 + i, f"{i}: in WHICH year did the old mill burn down, 95") for i in range(12)]  # no less a leak for standing in many
    out += [(200, "a rare word here"), (201, "a rare word, of the same"), (202, "zyx"), (203, "rare\nword"), (204, "which year did the old mill burn down")]
    out += [(300 + i, f"four such words here {i}") for i in range(11)]
    out += [(400, "one two three four five six seven eight nine ten"), (401, "two three four five six seven eight nine ten"), (402, "twice and twice " * 8), (403, ""), (404, None)]
    return out


def test_short_items_drop_documents(spark, tmp_path):
    docs = table(spark, planted())
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = benchmark_brute([tuple(r) for r in docs.collect()], ITEMS)
    assert sorted(r[0] for r in want) == [*range(40), 201, 203, 204, 401, 403, 404]
    assert rows(corpus_pipeline.decontaminated(spark, docs, str(tmp_path))) == want


def near_brute(docs):
    """The near-duplicate stage by its meaning: components of pairs at 80 % of five-word shingles."""
    sets = []
    for d in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (d[1] or "").encode().translate(LOW))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = [d[0] for d in docs]
    for _ in docs:
        for a in range(len(docs)):
            for b in range(a):
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    label[a] = label[b] = min(label[a], label[b])
    return sorted((d for d, x in zip(docs, label) if d[0] == x), key=repr)


def test_near_stage(spark):
    base = [f"w{n}" for n in range(60)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base[1:] + ["more"]), " ".join(base[:30]), " ".join(base[::-1]), " ".join(base).upper(), "short one", "SHORT  one", "short", "", None, "A.", "a.\n"]
    docs = table(spark, list(enumerate(texts)))
    want = near_brute(sorted(tuple(r) for r in docs.collect()))
    assert sorted(r[0] for r in want) == [0, 3, 4, 6, 8, 9, 10, 11]
    assert rows(corpus_pipeline.near_dedupe(spark, docs, "")) == want
