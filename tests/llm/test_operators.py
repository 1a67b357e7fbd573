"""Operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tidemark.llm import bytebpe, caps, extraction, lines, minhash, packing, quality, suffixes, urltree, warc
from tidemark.llm.common import Workspace

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the smallest table, with awkward ones added and columns whose names clash with inner ones."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words, 9000))
    passage = " ".join(f"p{i}" for i in range(60))
    base = " ".join(rng.choice(words, 120))
    near = base.split()
    near[50] = "changed"
    rows = [(900001, None), (900002, ""), (900003, " \n\t "), (900004, "one two"), (900005, "one two"), (900006, long), (900007, "a b c " + passage + " x y"), (900008, "q " + passage + " r\nzz"), (900009, base), (900010, " ".join(near)), (900010, " ".join(near)), (900011, "Ünïcode ﬁ 漢字 \u0301 😀 " * 30), (900012, base.upper())]
    extra = spark.createDataFrame([(i, t, "key", 1) for i, t in rows], "doc_id long, text string, bucket string, node int")
    from pyspark.sql import functions as F

    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("key").alias("bucket"), F.lit(1).alias("node")).unionByName(extra)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def empty(docs):
    return docs.where("false")


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def fold(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def test_minhash_is_brute_force(docs, texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(fold(t))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    holders, shared = defaultdict(list), Counter()
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    for found in holders.values():
        shared.update((b, a) for k, b in enumerate(found) for a in found[:k])
    want = components(sets, [p for p, n in shared.items() if 100 * n >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - n)])
    got = minhash.near_duplicates(docs, k=4).collect()
    assert len(got) == docs.count()
    assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id) for r in got)
    assert minhash.near_duplicates(empty(docs)).count() == 0


def word_set(text, k):
    w = WORD.findall(fold(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("members", [1024, 40])
def test_groups_near_the_threshold_make_no_pairs(spark, monkeypatch, members):
    monkeypatch.setattr(lines, "MEMBERS", members)
    written, save = Counter(), Workspace.save

    def counted(ws, df, name, rows=None):
        out = save(ws, df, name, rows)
        written[name] = out.count()
        return out

    rng = np.random.default_rng(7)
    texts = []
    for _ in range(300):  # variants of one text: most pairs are below the threshold, and share bands
        words = [f"w{i}" for i in range(200)]
        for k in rng.choice(200, int(rng.integers(3, 16)), replace=False):
            words[k] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(words))
    sets = [word_set(t, 4) for t in texts]
    links = [(a, b) for a in range(300) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(range(300), links)
    assert len(set(want.values())) > 50 and len(links) < 300 * 299 / 2 / 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(Workspace, "save", counted)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, k=4).collect()} == want
    assert max(written.values()) <= 24 * 300, written


def test_ids_with_several_texts_link_by_each(spark):
    rng = np.random.default_rng(8)
    base = [[f"{c}{i}" for i in rng.permutation(100)] for c in "abcd"]
    near = [" ".join([*w[:97], "y"]) for w in base]
    base = [" ".join(w) for w in base]
    rows = [(1, base[0]), (2, near[0]), (2, base[1]), (3, near[1]), (3, base[2]), (3, base[2]), (4, near[2]), (4, near[1]), (5, base[3]), (6, "other words")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert len(out) == len(rows) and {r.doc_id: r.component_id for r in out} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 2**63, 100).astype(np.uint64)])
    group = np.concatenate([np.zeros(500, int), np.ones(500, int), [2]])
    s = minhash.sketch(group, np.concatenate([a, b, [np.uint64(7)]]), 4, 384)
    assert (s[:3] < np.iinfo(np.uint64).max).all() and (s[3] == np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.12


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(file)
    got = packing.pack(docs, file, capacity=512).toPandas()
    by = got.drop_duplicates(["doc_id", "piece"]).sort_values(["doc_id", "piece"])
    for i, g in by.groupby("doc_id"):
        ids = np.array([*whole.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert g.length.sum() == len(ids) and list(g.start) == list(range(0, len(ids), 512))
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(g.start, g.length, strict=True)] == list(g.ids_crc32)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 512
    by_program, left = packing.by_program(np.bincount(got.length, minlength=513), 512)
    assert sum(n for _, n in by_program) > sum(n for _, n in packing.best_fit(left, 512)) > 0
    bound = -(-int(got.length.sum()) // 512)
    assert got.sequence_id.nunique() <= bound * 1.02 + 2
    assert packing.pack(empty(docs), file).count() == 0


def test_configurations_hold_every_piece():
    counts = np.zeros(65, np.int64)
    counts[[1, 5, 20, 33, 64]] = [700, 300, 90, 50, 3]
    plan = packing.solve(counts, 64)
    held = Counter()
    for pattern, times in plan:
        assert sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            held[k] += n * times
    assert all(held[k] == counts[k] for k in range(65))


@pytest.mark.parametrize("scale", [1, 3, 500])
def test_the_program_packs_most_at_every_size(scale):
    rng = np.random.default_rng(scale)
    counts = np.bincount(np.minimum(rng.lognormal(5, 1.2, 400 * min(scale, 20)).astype(int) + 1, 2048), minlength=2049) * -(-scale // 20)
    plan, left = packing.by_program(counts, 2048)
    rest = packing.best_fit(left, 2048)
    taken, plain = sum(n for _, n in plan), sum(n for _, n in packing.best_fit(counts, 2048))
    assert taken > sum(n for _, n in rest)
    assert taken + sum(n for _, n in rest) <= plain * 1.001 + 2


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    from tidemark.llm.subwords import WordIds

    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    spec["normalizer"] = None
    (tmp_path / "t.json").write_text(json.dumps(spec))
    text = "It's Über-long 12 words\u0301"
    want = Tokenizer.from_file(str(tmp_path / "t.json")).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(WordIds(str(tmp_path / "t.json")).encode(text), "<u4").tolist() == want


def test_suffixes_are_brute_force(docs, texts):
    words = {i: t.encode().split() for i, t in texts.items()}
    first, want, got = {}, defaultdict(set), defaultdict(set)
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            if first.setdefault(tuple(words[i][k : k + 50]), (i, k)) != (i, k):
                want[i].update(range(k, k + 50))
    for r in suffixes.passage_report(docs).collect():
        assert words[r.doc_id][r.start_word : r.start_word + r.n_words] == words[r.of_doc_id][r.of_start_word : r.of_start_word + r.n_words]
        got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    assert want == got and 900008 in got
    left = {r.doc_id: r.text for r in suffixes.remove_repeats(docs).collect()}
    assert left[900008] == "q r\nzz" and left[900001] is None and left[900004] == "one two"
    assert suffixes.passage_report(empty(docs)).count() == 0


def test_suffixes_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(12)
    passages = [[f"p{k}w{i}" for i in range(70)] for k in range(6)]
    rows = []
    for i in range(120):  # parts of a few passages in every text, so that runs are long and cross borders
        words = []
        for _ in range(3):
            p, low = passages[rng.integers(6)], int(rng.integers(0, 20))
            words += [*(f"f{i}x{x}" for x in rng.integers(0, 99, 5)), *p[low : low + int(rng.integers(45, 71))]]
        rows.append((i, " ".join(words)))
    first, want = {}, defaultdict(set)
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), (i, k)) != (i, k):
                want[i].update(range(k, k + 50))
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in ("2", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = defaultdict(set)
            found = suffixes.passage_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
            for r in found:
                got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
            assert got == want
            seen.append(sorted(found))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0] == seen[1]


def test_suffixes_leave_other_texts_of_an_id_alone(spark):
    p, q = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(200))
    rows = [(1, p, "a", 1), (2, "x " + p, "b", 2), (2, q, "c", 3), (2, q, "d", 4), (3, "y " + p, "e", 5), (None, p, "f", 6), (4, None, "g", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__doc` string, `cuts.k` int")
    out = suffixes.remove_repeats(docs)
    assert out.columns == docs.columns
    left = {(r[0], r[1], r[2]) for r in out.collect()}
    assert {(1, p, "a"), (2, q, "c"), (2, q, "d"), (3, "y ", "e"), (None, p, "f"), (4, None, "g")} <= left
    assert {r for r in left if r[2] == "b"} <= {(2, "x " + p, "b"), (2, "x ", "b")} and len(left) == 7


@pytest.mark.parametrize("partitions", ["7"])
def test_suffixes_find_what_members_of_a_run_share(spark, partitions):
    rows = []
    for c in range(40):  # the first text has the middle 50 words of a passage of 69 that two others share
        passage = [f"c{c}p{i}" for i in range(69)]
        middle = [*(f"a{c}x{i}" for i in range(9)), *passage[9:59], *(f"a{c}y{i}" for i in range(9))]
        rows += [(c, " ".join(middle)), (100 + c, " ".join([f"b{c}", *passage, f"b{c}z"])), (200 + c, " ".join([f"d{c}", f"e{c}", *passage, f"d{c}z"]))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = defaultdict(set)
        for r in suffixes.passage_report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
            got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for c in range(40):
        assert got[100 + c] == set(range(10, 60)) and got[200 + c] == set(range(2, 71))


def test_lines_are_brute_force(docs, texts):
    sets = {}
    for t in texts.values():
        for line in t.split("\n"):
            if WORD.search(line):
                own = line.lower().strip("\x20\x09\x0a\x0b\x0c\x0d")
                sets[line] = {own[k : k + 6] for k in range(max(1, len(own) - 5))}
    holders, links = defaultdict(list), []
    for line in sets:
        for s in sets[line]:
            holders[s].append(line)
    for line, s in sets.items():
        for other in {o for x in s for o in holders[x]}:
            if other < line and 100 * len(s & sets[other]) >= 80 * len(s | sets[other]):
                links.append((line, other))
    component, seen, want = components(sets, links), set(), defaultdict(list)
    for i in sorted(texts):
        for k, line in enumerate(texts[i].split("\n")):
            if WORD.search(line):
                if component[line] in seen:
                    want[i].append(k)
                seen.add(component[line])
    assert {r.doc_id: list(r.removed_lines) for r in lines.line_report(docs).collect()} == dict(want)
    left = lines.remove_duplicate_lines(docs)
    assert left.columns == docs.columns and {900001, 900002, 900003} <= {r.doc_id for r in left.collect()}
    assert lines.line_report(empty(docs)).count() == 0


def test_whole_lines_are_brute_force(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(60)]
    long = [" ".join(rng.choice(words, 40)) for _ in range(6)]
    texts = ["https://a.org/x/1", "https://b.net/yy/2", "International", "Internet", "1234567890123", "1234569999999", "漢字仮名交文一二三四五", "漢字仮名交文六七八九十", "ab", "AB ", "abc", *long, *[x[:200] + "QQ" + x[200:] for x in long], *[x[:70] + " " + x[90:] for x in long], *[" ".join(w[:6] + "z" for w in x.split()) for x in long], " \t", "x" * 64, "x" * 66 + "y"]
    sets = {}
    for t in texts:
        own = t.lower().strip(" \t\r")
        sets[t] = {own[k : k + 6] for k in range(max(1, len(own) - 5))} if own else set()
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[texts[a]] and sets[texts[b]] and 100 * len(sets[texts[a]] & sets[texts[b]]) >= 80 * len(sets[texts[a]] | sets[texts[b]])]
    component = components(range(len(texts)), links)
    want = {i for i in component if component[i] != i}
    assert len(want) >= 7 and not want & set(range(9))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in lines.line_report(docs).collect()} == want
    assert {r.doc_id for r in docs.join(lines.remove_duplicate_lines(docs), "doc_id", "left_anti").collect()} == want


@pytest.mark.parametrize("members, listed", [(1024, 16), (12, 16), (12, 2)])
def test_large_mixed_buckets_lose_no_link(spark, monkeypatch, members, listed):
    monkeypatch.setattr(lines, "MEMBERS", members)
    monkeypatch.setattr(lines, "HUBS", 4)
    monkeypatch.setattr(lines, "LISTED", listed)
    rng = np.random.default_rng(31)
    base = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "mnprs"]
    texts = []
    for _ in range(40):  # variants of one line, most of them below the threshold to most others
        words = list(base[:70])
        for k in rng.integers(0, 70, int(rng.integers(0, 9))):
            words[k] = str(rng.choice(base))
        texts.append(" ".join(words))
    texts += [t + "!" for t in texts[:15]]
    sets = [{t[k : k + 6] for k in range(len(t) - 5)} for t in texts]
    component = components(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in lines.line_report(docs).collect()} == {i for i in component if component[i] != i}


def test_families_are_compared_by_differences(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    base = rng.choice(words, 60)
    shares = rng.choice([0.01, 0.03, 0.3], lines.PIVOT_FROM + 20, p=[0.5, 0.4, 0.1])
    texts = [" ".join(np.where(rng.random(60) < share, rng.choice(words, 60), base)) for share in shares]
    sets = [{t[k : k + 6] for k in range(len(t) - 5)} for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    made = spark.createDataFrame(list(enumerate(texts)), "id long, own string").coalesce(1).select("id", lines.shingle_set(F.col("own")).alias("set"))
    unit = made.agg(F.collect_list(F.struct("id", "set")).alias("members")).select(lines.against_pivot(F.col("members"), ["id"]).alias("m"))
    pairs = F.transform("m", lambda x: F.transform("m", lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"), lines.shared_by(x, y).alias("shared"), lines.most_shared(x, y).alias("most"))))
    row = unit.select("m", F.flatten(pairs).alias("pairs")).first()
    assert all(p.shared == len(sets[p.a] & sets[p.b]) <= p.most for p in row.pairs)
    assert 3 * sum(len(m.plus) + len(m.minus) for m in row.m) < sum(m.n for m in row.m)
    unlike = [p for p in row.pairs if 180 * p.shared < 80 * (len(sets[p.a]) + len(sets[p.b]))]
    assert 2 * sum(180 * p.most < 80 * (len(sets[p.a]) + len(sets[p.b])) for p in unlike) > len(unlike) > 1000
    rows = spark.createDataFrame([(0, 1, i, i, True, [1], t) for i, t in enumerate(texts)], "unit long, bucket long, id long, comp long, asks boolean, buckets array<long>, own string")
    assert components(range(len(texts)), [tuple(r) for r in lines.meet(rows, 80).collect()]) == components(range(len(texts)), links)


def test_lines_whose_first_hashes_are_equal(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lines, "keys", lambda line: (F.length(line).cast("long"), F.xxhash64(line)))
    rows = [(1, "abcdefgh\nzyxwvuts\nother line"), (2, "abcdefgh\nqwertyui"), (3, "zyxwvuts")]
    out = lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed_lines for r in out} == {2: [0], 3: [0]}


def test_equal_lines_have_bands_once(spark):
    text = "a line of several words\n" * 50 + "another line here\n" + "a line of several words"
    docs = spark.createDataFrame([(1, 0, text), (2, 0, text)], "doc long, row long, text string").coalesce(1)
    docs = docs.selectExpr("doc", "row", "text", "xxhash64(doc, row) as place")
    found, heads = lines.identified(Workspace(spark, "test"), docs)
    made = lines.signed(lines.cut(docs, heads)).collect()
    assert found.count() == 104 and heads.count() == 2 and {r.size for r in made} == {18, 12}
    assert len({r.id for r in made}) == 2 and len({(r.id, r.band) for r in made}) == len(made)
    out = lines.line_report(docs.withColumnRenamed("doc", "doc_id")).collect()
    assert {r.doc_id: r.removed_lines for r in out} == {1: [*range(1, 50), 51], 2: [*range(52)]}


def test_lines_run_no_python_on_executors(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("DataFrame functions only")

    rows = [(1, "a line of several words\nanother line"), (2, "A line of several words!\nown words"), (3, "own words \nx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, refuse)
    assert {r.doc_id: r.removed_lines for r in lines.line_report(docs).collect()} == {2: [0], 3: [0]}
    assert {r.doc_id: r.text for r in lines.remove_duplicate_lines(docs).collect()} == {1: rows[0][1], 2: "own words", 3: "x"}


def test_lines_and_columns_of_any_name(spark):
    rows = [(1, "same line here", "a", 1), (2, "same line here\nown words", "b", 2), (2, "text of the same id", "c", 3), (None, "same line here", "d", 4), (3, None, "e", 5), (4, "same line here", "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `drops` string, `row.left` int")
    out = lines.remove_duplicate_lines(docs)
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, "same line here", "a", 1), (2, "own words", "b", 2), (2, "text of the same id", "c", 3), (None, "same line here", "d", 4), (3, None, "e", 5)], key=str)


def test_quality_counts_and_trees(spark, docs, texts):
    labels = quality.labelled(spark.read.parquet(f"{SF}/labels.parquet"))
    trees = quality.learn(docs.selectExpr("doc_id as id", "text"), labels)
    for r in quality.judge(docs, trees).collect():
        w = WORD.findall(texts[r.doc_id])
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeats = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        full = [x for x in texts[r.doc_id].split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", texts[r.doc_id])))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(full) - len(set(full)), len(repeats))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeats) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.keep_good(docs, trees).columns == docs.columns
    assert quality.judge(empty(docs), trees).count() == 0
    none = quality.learn(docs.selectExpr("doc_id as id", "text"), labels.where("false"))
    assert quality.judge(docs, none).where("kept = base_failed").count() == 0


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 2))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.standard_normal(3000) < 0.6).astype(float)
    trees = quality.fit(x[:2000], y[:2000], [-1, 0])
    assert ((trees.score(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    steps = np.linspace(0, 1, 50)
    for v in (0.1, 0.5, 0.9):
        assert (np.diff(trees.score(np.column_stack([steps, np.full(50, v)]))) <= 1e-9).all()


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.learn(docs.selectExpr("doc_id as id", "text"), quality.labelled(labels.where("doc_id % 3 <> 0")))
    held = quality.judge(docs, trees).join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed")
    assert held.where("kept = (quality = 1)").count() >= 0.95 * held.count()


def test_bpe_is_tiktoken(docs, texts):
    import tiktoken

    file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bytebpe.load_ranks(file)
    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bytebpe.digests(bytebpe.encode(docs, file, public_tokenizers.PATTERN)).collect()
    for r in got:
        ids = right.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bytebpe.encode(empty(docs), file, public_tokenizers.PATTERN).count() == 0


def test_bpe_prefixes_take_appends_and_edits():
    import tiktoken

    ranks = bytebpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary, rng = bytebpe.Vocabulary(ranks), np.random.default_rng(9)
    for letters in (b"aeinst", b" ", b" \n", bytes(range(256))):
        some = lambda n: bytes(rng.choice(np.frombuffer(letters, np.uint8), n))  # noqa: B023, E731
        data = some(700)
        prefixes = bytebpe.Prefixes(vocabulary, data)
        for _ in range(12):
            start, end = sorted(int(x) for x in rng.integers(0, len(data) + 1, 2))
            new, more = some(int(rng.integers(0, 9))), some(int(rng.integers(0, 5)))
            end = min(end, start + 9)
            data = data[:start] + new + data[end:] + more
            prefixes.replace(start, end, new)
            prefixes.append(more)
            assert prefixes.data == data and prefixes.ids() == right._encode_single_piece(data)
    for n in range(len(data)):  # every prefix ends with the token that the encoding of it ends with
        assert prefixes.last[n] == right._encode_single_piece(data[: n + 1])[-1]


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}", None if i == 5 else "é" * 600 if i % 3 == 0 else "z" * (i * 40)) for i in range(60)] + [(None, None, "a" * 2000), (7, "u", "q" * 3000), (7, "u", "q" * 3000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    ws = Workspace(spark, "test")
    warc.write(pages, ws.path("bundles"), ws.path("index"), ws)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and len(data) >= 1000 and largest[h or ""] != i
        want.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", str(largest[h or ""] if again else None)))
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.read_back(spark, ws.path("bundles")).collect()]
    assert sorted(got) == sorted(want)
    for r in spark.read.parquet(ws.path("index")).where("id = 12").collect():
        content = spark.read.format("binaryFile").load(f"{ws.path('bundles')}/bundle={r.bundle}").first().content
        assert warc.read_at(bytes(content), r.frame, r.offset)[0]["X-Page-Id"] == "12"
    warc.write(pages.where("false"), ws.path("none"), ws.path("none-index"), ws)
    assert warc.read_back(spark, ws.path("none")).count() == 0


def test_urls(spark):
    rows = [(1, "HTTP://Ex.COM"), (2, None), (3, "abc"), (4, "a://b?x/y"), (5, "a://EXAMPLE.com/en/7x#y"), (6, "x://notcom/en/"), (7, "q://com/en/"), (9, "a://h.net/de/8"), (10, "a://www.example.net/de/81?q"), (10, "a://x.org/es/"), (None, "a://x.org/es")]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urltree.judge(spark.createDataFrame(rows, "page_id long, url string"), urltree.RULES).collect()}
    assert {x for x in got if x[3]} == {(5, "example.com", "/en/7x", "example.com/en/7", "allow"), (7, "com", "/en/", "com/en/", "block"), (9, "h.net", "/de/8", "net/de/", "allow"), (10, "www.example.net", "/de/81", "example.net/de/8", "block"), (10, "x.org", "/es/", "org/es/", "block")}
    assert {x[:3] for x in got if not x[3]} == {(1, "ex.com", ""), (2, "", ""), (3, "", ""), (4, "b", ""), (6, "notcom", "/en/"), (None, "x.org", "/es")}
    spam = [(i, f"http://s.test/buy/{i}/x") for i in range(30)] + [(100 + i, f"http://s.test/wiki/{i}/x") for i in range(30)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in spam if i % 2], "id long, bad int")
    out = urltree.judge(spark.createDataFrame(spam, "page_id long, url string"), [], labels=labels).collect()
    assert all(r.verdict == ("block" if r.page_id < 100 else "allow") for r in out)


def url_tree(urls):
    """(host, path) -> (good, bad) to (host, path) -> (template, purity), by recursion over the tree."""
    from math import log

    def likelihood(k, n):
        return sum(x * log(x / n) for x in (k, n - k) if x > 0) if n else 0.0

    def differs(k, n, of, every):
        return 2 * (likelihood(k, n) + likelihood(of - k, every - n) - likelihood(of, every))

    def wild(s):
        return "*" if re.search("[0-9]", s) else s

    def smooth(rows, above):
        good, bad = (sum(r[i] for r in rows) for i in (2, 3))
        return (bad + 8 * above) / (good + bad + 8)

    def grow(rows, template, purity, k):
        for r in rows:
            if len(r[1]) <= k or (k and len(rows) == 1):
                out[r[0]] = (template + "".join("/" + wild(s) for s in r[1][k:]), purity)
        if k and len(rows) == 1:
            return
        branches = defaultdict(list)
        for r in rows:
            if len(r[1]) > k:
                branches[wild(r[1][k])].append(r)
        named = {s: (len(b), sum(x[2] for x in b), sum(x[3] for x in b), sum(len(x[1]) > k + 1 for x in b)) for s, b in branches.items() if s != "*"}
        n, good, bad, inner = (sum(v[i] for v in named.values()) for i in range(4))
        merged = defaultdict(list)
        for s, b in branches.items():
            to = s
            if s != "*":
                v = named[s]
                variable = len(named) >= 8 and len(named) >= 0.5 * n
                alike = len(named) > 1 and differs(v[2], v[1] + v[2], bad, good + bad) <= 3.841 and differs(v[3], v[0], inner, n) <= 3.841
                to = "*" if variable or alike else s
            merged[to] += b
        for to, b in merged.items():
            grow(b, f"{template}/{to}", smooth(b, purity), k + 1)

    out, rows = {}, [((h, p), [s for s in p.split("/") if s], *c) for (h, p), c in urls.items()]
    good, bad = (sum(r[i] for r in rows) for i in (2, 3))
    for host in {r[0][0] for r in rows}:
        own = [r for r in rows if r[0][0] == host]
        grow(own, "", smooth(own, (bad + 1) / (good + bad + 2)), 0)
    return out


@pytest.mark.parametrize("source", ["made", "sf0.01"])
def test_url_tree_is_brute_force(spark, source):
    rng = np.random.default_rng(20)
    if source == "made":
        kinds = ["buy", "wiki", "news", "blog", "shop", "tags", "a1", "x"]
        rows = []
        for i in range(900):
            kind = kinds[rng.integers(8)]
            rows.append((i, f"http://h{rng.integers(3)}.test/{kind}/" + "/".join(["s" + "abcdefgh"[rng.integers(8)], f"p{rng.integers(40)}", "deep", "deeper", "good" if i % 2 else "bad", f"n{i}"][: rng.integers(1, 7)])))
        rows += [(1000 + i, f"http://d.test/a/b/c/d/{'good' if i % 2 else 'bad'}/x/p{i}") for i in range(40)] + [(2000, None), (2001, "http://h0.test"), (2002, "http://one.test/only/1")]
        bad = {i: int("buy" in u or "/bad/" in u) for i, u in rows if u and i % 3 and i < 2000}
    else:
        rows = [(r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
        bad = {}
    out = urltree.judge(spark.createDataFrame(rows, "page_id long, url string"), urltree.RULES, labels=spark.createDataFrame(list(bad.items()), "id long, bad int")).collect()
    urls = defaultdict(lambda: [0, 0])
    for r in out:
        said = bad.get(r.page_id, {"allow": 0, "block": 1}.get(r.verdict) if r.rule else None)
        counts = urls[r.host, r.path]
        if said is not None:
            counts[said] += 1
    want = url_tree(urls)
    for r in out:
        template, purity = want[r.host, r.path]
        assert (r.template, round(r.purity, 9)) == (template, round(purity, 9))
        assert r.rule or r.verdict == ("block" if purity >= 0.7 else "allow")
    undecided = {r.verdict for r in out if not r.rule}
    assert undecided == {"allow", "block"}
    if source == "made":
        assert all(r.verdict == ("block" if "/bad/" in r.path else "allow") for r in out if r.host == "d.test")


def test_urls_have_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.01/pages.parquet"
    got = sorted(tuple(map(str, (r.page_id, r.host, r.path, r.rule))) for r in urltree.judge(spark.read.parquet(path), urltree.RULES).collect())
    fits = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{h}/{p}'" for h, _, p in (t.partition("/") for t, _ in sorted(urltree.RULES, key=lambda r: -len(r[0]))))
    sql = f"with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from '{path}'), p as (select page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u) select page_id, host, path, case {fits} end as rule from p"
    assert sorted(tuple(map(str, r)) for r in duckdb.sql(sql).fetchall()) == got


def test_extraction(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a>Home</a></li></ul></nav><div class=\"content\"><h2>Title here</h2><p>A long paragraph of words &amp; more\n words.</p><div class=\"ad-box\">Buy now</div><p>Second <a href='x'>linked</a> one<br>continues.</p><form>Name <input></form><section class=\"comments\"><p>I think so too, very nice indeed</p></section></div><script>var t=\"</p>\";</script><footer>c 2020</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>only &lt;text"), (None, "u", page), (5, "u", "<b>x" * 3000)]
    got = {(r.page_id): (r.text, r.n_chars) for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "Title here\nA long paragraph of words & more words.\nSecond linked one continues."
    assert got[1] == got[None] == (text, len(text)) and got[2] == got[3] == ("", 0) and got[4] == ("only <text", 10) and got[5][1]
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    texts = {r.page_id: r.text for r in extraction.main_text(pages).collect()}
    for r in pages.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        import html

        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert texts[r.page_id] == "\n".join(b for b in blocks if b)


def test_caps_are_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32))
    rows = [(i, [float(v) for v in centres[i % 40] + 0.3 * rng.random() * rng.standard_normal(32)], i % 2) for i in range(600)]
    rows += [(600, rows[0][1], 0), (601, rows[0][1], None), (602, None, 0), (603, [0.0] * 32, 0), (604, [float("nan")] * 32, 0), (605, [None] + [1.0] * 31, 0), (606, [], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [(i, np.array(v, np.float32).astype(float), k) for i, v, k in rows if k is not None and i <= 600]
    unit = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    close = (unit @ unit.T >= 0.93) & (np.array([k for *_, k in good])[:, None] == np.array([k for *_, k in good]))
    np.fill_diagonal(close, False)
    want = components([r[0] for r in rows], [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(close), strict=True)])
    n = {i: int(c) for (i, *_), c in zip(good, close.sum(axis=1), strict=True)}
    assert close.sum() > 500
    found = sum(v[0] for v in got.values())
    assert close.sum() * 0.99 <= found <= close.sum() and all(v[0] <= n.get(i, 0) for i, v in got.items())
    assert sum(got[i][1] == want[i] for i in want) >= 0.99 * len(want) and all(got[i] == (0, i, True) for i in range(601, 607))


def test_caps_keep_recall_at_the_largest_code(spark, monkeypatch):
    monkeypatch.setattr(caps, "BUCKET", 1e-6)  # 2048 codewords for a small table
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((2, 1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, y]))]
    out = caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sum(r.n_links for r in out) >= 2 * 1000 * 0.995


def test_caps_in_few_dimensions_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(d * 1000 + i, rng.standard_normal(d).tolist(), 0) for d in (1, 2, 3) for i in range(150)]
    out = {r.vec_id: r.n_links for r in caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    for d in (1, 2, 3):
        x = np.array([v for i, v, _ in rows if i // 1000 == d], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert [out[d * 1000 + i] for i in range(150)] == ((x @ x.T >= 0.93).sum(axis=1) - 1).tolist()


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "suffix dedup", "best-fit packing"]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() and set(out.columns) >= {"doc_id", "sequence_id", "offset"}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
