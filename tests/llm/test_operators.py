"""Operators against plain versions on small tables, and their defined edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from lodestone.llm import decontam, exact, language, lines, links, mixing, near, pii, quality
from lodestone.llm.common import table
from pyspark.sql import functions as F

TEXTS = "doc_id bigint, text string, source string, id int, node string, key string, kept int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, 1, "n", "k", 0) for i, t, s in rows], TEXTS)


EDGES = [(1, None, "a"), (2, "", None), (3, "Same text", "a"), (4, "same TEXT", "b"), (4, "same TEXT", "b"),
         (None, "same text", "a"), (5, "é É", ""), (6, "word " * 30_000, "a")]


@pytest.mark.parametrize("bits", [64, 3])  # 3: nearly every hash is a collision
def test_exact(spark, bits):
    rng = random.Random(1)
    rows = EDGES + [(100 + i, rng.choice(["x", "X", "y", "zz", f"t{i}"]), "s") for i in range(300)]
    groups = defaultdict(list)
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    for i, t, _ in rows:
        groups[low(t)].append(i)
    want = []
    for i, t, _ in rows:
        top = max((x for x in groups[low(t)] if x is not None), default=None)
        want.append((i, top, len(groups[low(t)]), i == top, hashlib.sha256(low(t).encode()).hexdigest()))
    got = exact.dedup_exact(frame(spark, rows), bucket_keys=8, hash_bits=bits).collect()
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert exact.dedup_exact(frame(spark, rows).limit(0)).collect() == []


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.range(5000).selectExpr("case when id < 4000 then shiftrightunsigned(xxhash64(id), 4) else xxhash64(id) end as h")
    cells, depth = exact.build_directory(keys, 100)
    rows = cells.collect()
    assert max(r["local_depth"] for r in rows) == depth > min(r["local_depth"] for r in rows)
    placed = keys.withColumn("cell", exact.cell_of(keys["h"], depth)).join(cells, "cell").groupBy("bucket").count().collect()
    assert max(r["count"] for r in placed) <= 100 and sum(r["count"] for r in placed) == 5000


def test_pfair_stays_within_one_block():
    for parts in ([1], [3, 2, 1], [65, 7, 7, 1, 1, 30], [5] * 9):
        served, total = [0] * len(parts), sum(parts)
        for t, i in enumerate(mixing.pfair(parts), 1):
            served[i] += 1
            assert all(abs(s * total - t * a) < total for s, a in zip(served, parts))
        assert served == parts


def test_mix(spark):
    rows = EDGES + [(1000 + i, "t", "a" if i % 3 else "b") for i in range(400)]
    got = mixing.mix(frame(spark, rows), {"a": 3, "b": 2, None: 1}, block_rows=4).collect()
    assert len(got) == len(rows)
    blocks = Counter(r["mix_position"] for r in got)
    assert sorted(blocks) == list(range(1, len(blocks) + 1))
    assert all(len({r["source"] for r in g}) == 1 for _, g in itertools.groupby(
        sorted(got, key=lambda r: r["mix_position"]), key=lambda r: r["mix_position"]))
    assert mixing.mix(frame(spark, rows).limit(0)).collect() == []
    again = mixing.mix(spark.createDataFrame([(1, "a", 5)], "doc_id int, source string, mix_position int"))
    assert len(set(again.columns)) == 5


def test_mix_of_many_sources(spark, monkeypatch):
    many = spark.range(3000).selectExpr("id as doc_id", "cast(id % 1600 as string) as source")
    got = mixing.mix(many, block_rows=1).collect()  # over 100,000 slots
    assert sorted(r["mix_position"] for r in got) == list(range(1, 3001))
    first = [r["source"] for r in sorted(got, key=lambda r: r["mix_position"])[:1600]]
    assert len(set(first)) > 1500
    rows = frame(spark, EDGES + [(1000 + i, "t", "a" if i % 3 else "b") for i in range(400)])
    key = lambda r: (r["doc_id"] or 0, r["mix_position"], r["mix_row"])
    for parts in (None, {"a": 3, "b": 2, None: 1}):
        want = sorted(mixing.mix(rows, parts, block_rows=4).collect(), key=key)
        with monkeypatch.context() as m:
            m.setattr(mixing, "MOST_COUNTERS", 0)
            assert sorted(mixing.mix(rows, parts, block_rows=4).collect(), key=key) == want


def test_decontamination_edges(spark):
    words = [f"w{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(words[:12])), (2, "Tiny ITEM"), (3, None), (4, "..."), (5, " ".join(words[:12]))],
                                  "item_id bigint, text string")
    rows = EDGES + [(20, "x " + "--".join(words[:10]) + " y", "s"), (21, " ".join(words[1:10]), "s"),
                    (22, "a tiny item, tiny item", "s"), (20, "clean", "s")]
    got = decontam.contamination(frame(spark, rows), items).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    assert (by[20, 12]["n_hit"], by[20, 12]["n_items"]) == (10, 2) and by[20, 1]["n_hit"] == 0
    assert by[21, 9]["n_hit"] == 0 and (by[22, 5]["n_hit"], by[22, 5]["n_items"]) == (4, 1)
    assert by[20, 12]["items_sha256"] == hashlib.sha256(b"1,5").hexdigest()
    kept = decontam.drop_contaminated(frame(spark, rows), items)
    assert kept.count() == len(rows) - 2 and kept.columns == frame(spark, rows).columns
    cut = {(r["doc_id"], r["text"]) for r in decontam.cut_spans(frame(spark, rows), items).collect()}
    assert (20, "x  y") in cut and (20, "clean") in cut and (1, None) in cut
    assert decontam.contamination(frame(spark, rows), items.limit(0)).where("n_hit > 0").count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        up[find(a)] = find(b)
    got = {r["node"]: r["root"] for r in links.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    for x, y in itertools.combinations(got, 2):
        assert (got[x] == got[y]) == (find(x) == find(y))


def test_components_contract_stars_at_once_and_paths_in_few_rounds(spark, monkeypatch):
    names, plain = [], links.checkpointed
    monkeypatch.setattr(links, "checkpointed", lambda df, name: names.append(name) or plain(df, name))
    star = spark.range(1, 3001).selectExpr("cast(0 as bigint) as a", "id as b")
    assert links.components(star).select("root").distinct().count() == 1 and names.count("up") == 1
    names.clear()
    path = spark.range(2000).selectExpr("id as a", "id + 1 as b")
    assert links.components(path).select("root").distinct().count() == 1 and names.count("up") < 25


def grams(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(400)]
    rows = []
    for g in range(25):
        words = rng.choices(vocab, k=rng.randint(8, 300))
        for c in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 3, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((g * 10 + c, " ".join(copy), "s"))
    sets = {i: grams(t) for i, t, _ in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: r for r in near.find_groups(frame(spark, rows)).collect()}
    assert {i: got[i]["class_id"] for i in got} == {i: find(i) for i in sets}
    assert sum(r["kept"] for r in got.values()) == len({find(i) for i in sets})


def test_near_weighs_repeated_shingles(spark):
    """Classes against all pairs of weighted sets: a passage said twice and nine times is not the same."""
    rng = random.Random(5)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(60)]
        for c in range(4):
            own = list(words)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(60)] = f"x{rng.randrange(10 ** 6)}"
            rows.append((g * 10 + c, " ".join(own + words[:20] * rng.choice([0, 1, 1, 2, 9])), "s"))

    def bag(text):
        words = text.split()
        return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))

    bags = {i: bag(t) for i, t, _ in rows}
    up = {i: i for i in bags}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(bags, 2):
        if (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total():
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: r["class_id"] for r in near.find_groups(frame(spark, rows)).collect()}
    assert got == {i: find(i) for i in bags}
    assert len(set(got.values())) > 12


def test_near_edges(spark):
    got = near.find_groups(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    size = {r["doc_id"]: r["class_size"] for r in got}
    assert size[1] == 2 and size[2] == 2 and size[3] == 4 and size[6] == 1
    assert near.keep_one(frame(spark, EDGES)).columns == frame(spark, EDGES).columns
    assert near.find_groups(frame(spark, EDGES).limit(0)).collect() == []


def test_dart_signatures_estimate_weighted_jaccard():
    import numpy as np
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300).astype(float), rng.integers(1, 9, 300).astype(float)
    sig = near.dart_signatures(np.repeat([0, 1], 300), np.concatenate([keys, keys]), np.concatenate([a, b]), 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_lines(spark):
    line = "the quick brown fox jumps over the lazy dog near the river bank today and again tomorrow morning at dawn"
    rows = [(1, f"{line}\nfirst own line of text here\n\nshort", "s"), (2, f"other words entirely different\n{line}!", "s"),
            (3, "Short \nSHORT", "s"), (3, "Short \nSHORT", "s"), (4, None, "s"), (5, "", "s"), (None, "unique tail", "s")]
    got = {(r["doc_id"], r["text"]) for r in lines.drop_lines(frame(spark, rows)).collect()}
    assert (1, rows[0][1]) in got and (2, "other words entirely different") in got
    assert (3, "") in got and (4, None) in got and (5, "") in got and (None, "unique tail") in got
    digest = lines.deduplicated(frame(spark, rows)).collect()
    assert len(digest) == len(rows) and {r["n_removed"] for r in digest if r["doc_id"] == 2} == {1}
    assert lines.deduplicated(frame(spark, rows).limit(0)).collect() == []


def test_lines_against_all_pairs_of_character_shingles(spark):
    rng = random.Random(11)
    texts = ["the answer is yes", "the answer is no", "chapter 1: page 10", "chapter 1: page 11",
             "tail \r one two three four", "tail \r one two three five", "😀😁😂🤣😃😄😅😆😉😊😋😎", "😀😁😂🤣😃😄😅😆😉😊😋😍"]
    texts += [f"https://www.example.org/{rng.randrange(10 ** 12)}/{rng.randrange(10 ** 12)}" for _ in range(20)]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60)) for _ in range(10)]
    for t in texts[-30::3]:
        at = rng.randrange(len(t) - 1)
        texts += [f"{t}0", f"{t[:at]}x{t[at + 1:]}"]
    texts = sorted(set(texts))
    sets = {t: {t[i:i + 9] for i in range(max(1, len(t) - 8))} for t in texts}
    up = {t: t for t in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(texts, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = lines.drop_lines(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"] for r in got if r["text"]} == {texts.index(find(t)) for t in texts}
    assert len(texts) > len({find(t) for t in texts}) > 30


def test_shingles_cut_from_bytes_hash_like_those_of_the_pattern(spark):
    texts = ["", "short", "exactly 9", "ten letters", "naïve façade of été", "ab é", "😀😁😂🤣😃😄😅😆😉😊😋😎", "a\nb\rc d e f g h", "x" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, line string")
    want = {r["node"]: Counter(r["h"]) for r in rows.select(
        "node", F.transform(lines.shingles(F.col("line")), lambda s: F.xxhash64(s)).alias("h")).collect()}
    got = {k: Counter() for k in want}
    for r in lines.hashed_shingles(rows).collect():
        got[r["node"]][r["h"]] += 1
    assert got == want


def test_long_lines_below_the_similarity_are_not_paired(spark, monkeypatch):
    """Members of one bucket, of 590 shingles each and a similarity of about 0.7: few pairs fetch their texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    base, texts = [word() for _ in range(75)], []
    for _ in range(40):
        own = list(base)
        for k in rng.sample(range(75), 4):
            own[k] = word()
        texts.append(" ".join(own))
    sets = [{t[i:i + 9] for i in range(len(t) - 8)} for t in texts]
    near_ones = sum(len(a & b) >= 0.75 * len(a | b) for a, b in itertools.combinations(sets, 2))
    counts, plain = {}, links.checkpointed

    def counted(df, name):
        out = plain(df, name)
        counts.setdefault(name, out.count())
        return out

    monkeypatch.setattr(links, "checkpointed", counted)
    lines.deduplicated(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert counts["open"] > 40 and counts["rest"] <= near_ones + 40 < 390


def test_base_spans_match_plain_patterns():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
            "card": lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    rng = random.Random(2)
    parts = ["a@b.c", "x.y+z@", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "+", "12", "é", " ", "-", "9" * 25, "a.b@c.d@e.f", "0001.2.3.4"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 7)))
        for kind in pii.KINDS:
            want = [m.span() for m in re.finditer(plain[kind], text) if good[kind](m.group())]
            assert pii.base_spans(text)[kind] == want, (kind, text)


def test_pii_finds_rewritten_spans(spark, sf):
    sample = [r["text"] for r in table(spark, sf.replace("0.001", "0.01"), "documents").collect()]
    weights = pii.fit(sample[:300])
    base, both = pii.find_spans("call (858) 555-2896 now", weights)
    assert base == [] and (3, 5, 19) in both
    assert pii.find_spans("under version 3. See 4.0 and the rest.", weights) == ([], [])
    got = pii.detect(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and {r["spans"] for r in got} == {""}
    assert pii.detect(frame(spark, EDGES).limit(0)).collect() == []


def test_pii_decodes_whole_runs_of_tokens(monkeypatch):
    import numpy as np
    text = "17, 4, 2024-05-01, 0049 30 1234567"
    assert [t for t, in [(text[r[0][0]:r[-1][1]],) for r in pii.regions(text, [])]] == [text]
    assert pii.regions("a " + "7" * 100 + " b", []) == [[(0, 1), (2, 102), (103, 104)]]
    rng = random.Random(4)
    weights = pii.Weights()
    texts = ["".join(rng.choices(["12", "a", "@", " ", " ", ", ", ".", "word ", "x" * 50 + " ", "  ", "+", "c-d "], k=90)) for _ in range(60)]
    for t in texts:
        for r in pii.regions(t, []):
            weights.codes(pii.segments(t, r), learn=True)
    weights.table = np.random.default_rng(4).normal(0, 1, (len(weights.place) + 1, len(pii.KINDS)))
    monkeypatch.setattr(pii, "ENDS", 3)
    for t in texts:
        base, both = pii.find_spans(t, weights)
        taken, want, run = [x[1:] for x in base], list(base), []
        for m in [*pii.TOKEN.finditer(t), None]:  # all tokens of a run at once
            bad = m is not None and any(s < m.end() and m.start() < e for s, e in taken)
            if run and (m is None or bad or m.start() - run[-1][1] > pii.GAP):
                cands = pii.segments(t, run)
                if cands:
                    want += [(k, run[i][0], run[j - 1][1]) for i, j, k in
                             pii.best_segments(len(run), list(cands), weights.scores(weights.codes(cands)))]
                run = []
            if m is not None and not bad:
                run.append(m.span())
        assert both == sorted(want)


def test_segmentation_against_all_segmentations():
    import numpy as np
    rng = np.random.default_rng(0)
    n = 5
    bounds = [(i, j) for i in range(n) for j in range(i + 1, n + 1)]
    s = rng.normal(0, 1.5, (len(bounds), len(pii.KINDS)))

    def every(i):
        if i == n:
            yield 0.0, ()
            return
        for score, rest in every(i + 1):
            yield score, rest
        for row, (a, b) in enumerate(bounds):
            if a == i:
                for k in range(len(pii.KINDS)):
                    for score, rest in every(b):
                        yield score + s[row, k], ((a, b, k), *rest)
    paths = list(every(0))
    assert pii.best_segments(n, bounds, s) == list(max(paths)[1])
    total = sum(np.exp(x) for x, _ in paths)
    got = pii.expectations(n, bounds, s)
    for row, (a, b) in enumerate(bounds):
        want = sum(np.exp(x) for x, p in paths if (a, b, 0) in p) / total
        assert got[row, 0] == pytest.approx(want)


def test_classifier_and_language_held_out(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.85
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) / len(found) > 0.97
    assert len(quality.keep_good(frame(spark, EDGES), labels).columns) == 7


def test_language_knows_rare_words_of_a_large_language(spark):
    import math
    import zlib
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    held = [i for i in range(200) if i not in train]
    docs = [(train[0], "common " * 150_000 + "zyxo", "a"), (train[1], "zywo other", "b"), (train[2], "vowel", None),
            (held[0], "zyxo", None), (held[1], "zywo zyxo zyxo", None), (held[2], "zyxe", None), (held[3], "1 2", None)]
    seen = {("a", n): Counter() for n in range(6)} | {("b", n): Counter() for n in range(6)}
    parts = lambda w, n: [f" {w} "[i:i + n] for i in range(len(w) + 3 - n)] if n else [w]
    for _, t, g in docs[:2]:
        for w, n in itertools.product(t.split(), range(6)):
            seen[g, n].update(parts(w, n))
    total = {k: sum(c.values()) for k, c in seen.items()}
    floor = min(-5, -math.log10(max(total.values()))) - 1

    def score(w, g):
        for n in (0, 5, 4, 3, 2, 1):
            if any(p in seen[x, n] for x in "ab" for p in parts(w, n)):
                each = [math.log10(seen[g, n][p] / total[g, n]) if p in seen[g, n] else floor for p in parts(w, n)]
                return sum(each) / len(each)
        return floor
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(rows).collect()}
    assert len(got) == 7 and got[held[0]]["lang_pred"] == "a" and got[held[3]]["lang_pred"] == "und"
    for i, t, _ in docs[2:6]:
        mean = [sum(score(w, g) for w in t.split()) / len(t.split()) for g in "ab"]
        belief = [10 ** ((m - max(mean)) * min(len(t.split()), 10)) for m in mean]
        assert got[i]["lang_pred"] == "ab"[mean.index(max(mean))]
        assert got[i]["score"] == pytest.approx(1 / sum(belief), abs=1e-6)


def test_classifier_and_language_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.classify(frame(spark, EDGES), none).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    docs = frame(spark, EDGES).withColumnRenamed("source", "lang")
    found = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert found[1]["lang_pred"] == "und" and found[2]["lang_pred"] == "und" and len(found) == 7
    assert language.identify(docs.limit(0)).collect() == []


def test_language_answers_are_packed_by_chunk(monkeypatch):
    """A chunk's answers are one row of a few bytes a word, whatever order they come in."""
    import numpy as np
    import pyarrow as pa
    rng = random.Random(8)
    rows = [(rng.choice([5, 9]), k, [j for j in range(k % 3)], [rng.choice([10 ** 9, 2 * 10 ** 9]) for _ in range(k % 3)]) for k in range(3000)]
    rng.shuffle(rows)
    kinds = [("of", pa.int64()), ("at", pa.int32()), ("place", pa.list_(pa.int32())), ("gain", pa.list_(pa.int64()))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[low:low + 700]), kinds)], [n for n, _ in kinds])
               for low in range(0, 3000, 700)]
    monkeypatch.setattr(language, "PACKED_ROWS", 1500)
    got, room, packs = {}, 0, 0
    for b in language.pack_answers(iter(batches)):
        for r in b.to_pylist():
            at, sizes, place, gain = (language.unpacked(r[c], t) for c, t in
                                      (("at", np.int32), ("sizes", np.int32), ("place", np.int32), ("gain", np.int64)))
            ends = np.cumsum(sizes)
            for a, low, high in zip(at.tolist(), ends - sizes, ends):
                got[r["of"], a] = (place[low:high].tolist(), gain[low:high].tolist())
            room, packs = room + sum(len(r[c]) for c in ("at", "sizes", "place", "gain")), packs + 1
    assert got == {(of, at): (place, gain) for of, at, place, gain in rows}
    assert packs == 4 and room < 8 * len(rows)
    assert list(language.pack_answers(iter([]))) == []


def test_language_documents_of_words_pack_as_gaps():
    import numpy as np
    rng = np.random.default_rng(2)
    each = [np.sort(rng.choice(5000, n, replace=False)).astype(np.uint32) for n in [1, 4000, 1, 2, 900, 3]]
    docs, sizes = np.concatenate(each), np.array([len(e) for e in each], np.uint32)
    assert language.from_gaps(language.gaps(docs, sizes), sizes).tolist() == docs.tolist()
    assert len(language.packed(language.gaps(docs, sizes))) < 0.8 * len(language.packed(docs))
    none = np.zeros(0, np.uint32)
    assert language.from_gaps(language.gaps(none, none), none).tolist() == []


def test_language_chunk_holds_little_beside_its_texts():
    """Words as Python strings, and the facts of all words at once, took about 19 bytes a character."""
    import tracemalloc
    import pandas  # noqa: F401  pyarrow loads it at some point, which would count
    import pyarrow as pa
    rng = random.Random(6)
    pool = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(60_000)]
    texts = [" ".join(rng.choices(pool, k=1000)) for _ in range(300)]
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.bool_())),
                        ("many", pa.list_(pa.int64())), ("sizes", pa.binary()), ("docs", pa.binary()),
                        ("counts", pa.binary()), ("at", pa.int32()), ("word", pa.string()),
                        ("langs", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])
    pa.array(language.Words(texts[:1]).word_keys())
    tracemalloc.start()
    try:
        chunk = language._Chunk()
        for low in range(0, 300, 20):
            chunk.add(list(range(low, low + 20)), [False] * 20, ["x"] * 20, texts[low:low + 20])
        batches = list(chunk.rows(schema))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 13 * sum(map(len, texts)), peak
    assert batches[0]["many"][0].as_py() == [1000] * 300 and max(b.num_rows for b in batches[1:]) <= 1 << 15
    got = {w: sum(n) for b in batches[1:] for w, n in zip(b["word"].to_pylist(), b["times"].to_pylist())}
    assert got == Counter(" ".join(texts).split())
    assert [k for b in batches[1:] for k in b["at"].to_pylist()] == list(range(len(got)))


def test_training_holds_two_bytes_a_symbol():
    for text in ("", "abc", "a long text, a long text, a long text é"):
        assert quality.symbols(text).itemsize == 2
    again = quality.symbols("abcdefgh" * 3)
    assert (again % 256).tolist() == list(b"abcdefgh" * 3) and again.max() == 256 + ord("h")


def test_signatures_take_several_shingles_a_row(spark):
    """Shingles of any characters become rows by fours, and no piece is decoded on its own."""
    rng = random.Random(12)
    word = lambda letters: "".join(rng.choices(letters, k=6))
    rows, pairs = [], []
    for k, letters in enumerate(["abcdefghij", "aéîoüxyz", "日本語文字列検索", "😀😁😂🤣x"] * 30):
        text = " ".join(word(letters) for _ in range(rng.randint(2, 40)))
        rows += [(3 * k, text), (3 * k + 1, text + "!"), (3 * k + 2, " ".join(word(letters) for _ in range(20)))]
        pairs += [(3 * k, 3 * k + 1)] if len(text) >= 60 else []
    rows += [(1000, "x"), (1001, "exactly 9"), (1002, "ten letters")]
    found = lines.band_members(spark.createDataFrame(rows, "node bigint, line string"), 9, 8, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "decode(" not in plan and len(set(re.findall(r"xxhash64\(substring\(body#\d+, .*? AS (h\d)#", plan))) == lines.ABREAST, plan
    keys = {}
    for r in found.collect():
        keys.setdefault(r["node"], []).append(r["key"])
    assert len(keys) == len(rows) and all(len(set(v)) == 8 for v in keys.values())
    assert len(pairs) > 60 and all(set(keys[a]) & set(keys[b]) for a, b in pairs)
    assert not any(set(keys[a]) & set(keys[a + 2]) for a, _ in pairs)


def test_texts_are_hashed_once_and_not_for_each_line(spark):
    plan = lines._lines(frame(spark, [(1, "a\nb", "s")]).repartition(2), "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("xxhash64("), plan


def test_lines_compared_by_known_sizes(spark):
    """Links at the similarity itself stay, also where shingles repeat; verification is given the sizes."""
    plain = "abcdefghijklmnopqrstuvwxyz0123456789"
    texts = [plain + "!", plain + "?", plain[:26], plain[:25] + "!", "z" * 40, "z" * 90, "é" * 30, "é" * 50, plain[:20] + "a" * 30, plain[:20] + "a" * 60]
    sets = {t: {t[i:i + 9] for i in range(len(t) - 8)} for t in texts}
    want = {tuple(sorted((texts.index(a), texts.index(b)))) for a, b in itertools.combinations(texts, 2)
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = lines.drop_lines(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"] for r in got if not r["text"]} == {b for _, b in want} and (4, 5) in want and (8, 9) in want
