"""Manifest, set join and hard negatives on small tables with every edge case, against brute force."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import chat, hard_negatives, main_text, merkle, ngram_join

# Extra columns have the names of results and of inner columns.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, digest string, c string, matches string"


def _docs(spark, rows, parts=3):
    full = [(i, t, lang, source, None if t is None else len(t), "l", "d", "c", "m") for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _tree(level):
    out = [level]
    while len(level) > 1:
        level = [_h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        out.append(level)
    return out


def _manifest(rows):
    """doc_id, leaf, subroot, root, proof digest and folded root of every row, tampered where 3 divides doc_id."""
    leaves = {}
    for i, t, lang, source in rows:
        low = None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        chars = None if t is None else len(t)
        leaf, seen = (_h(*map(_field, (i, source, lang, chars, x))) for x in (t, low))
        leaves.setdefault(lang, []).append(((i is not None, i or 0, leaf), leaf, seen if i is not None and i % 3 == 0 else leaf, i))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        leaves[lang].sort(key=lambda x: x[0])
        trees[lang] = _tree([x[1] for x in leaves[lang]])
    top, out = _tree([trees[lang][-1][0] for lang in langs]), []
    for number, lang in enumerate(langs):
        for place, (_, leaf, seen, i) in enumerate(leaves[lang]):
            proof, folded = [], seen
            for tree, at in ((trees[lang], place), (top, number)):
                for level in tree[:-1]:
                    run = level[at // 8 * 8 :][:8]
                    proof += [x for n, x in enumerate(run) if n != at % 8]
                    folded = _h(*run[: at % 8], folded, *run[at % 8 + 1 :])
                    at //= 8
            out.append((i, leaf, trees[lang][-1][0], top[-1][0], _h(*proof), folded, folded == top[-1][0]))
    return out


def _key(row):
    return tuple((x is None, x) for x in row)


MANY = [(i, f"Text {i} É" * (i % 5), lang, None if i % 4 else "ä") for i, lang in zip(range(700), ["en", None, "", "de", "en", "en", "z"] * 100, strict=True)]
ODD = [(None, "A", "en", "s"), (None, None, "en", None), (3, "A", "en", "s"), (3, "A", "en", "s"), (3, "B", "en", "s"), (9000, "X" * 100_000, "fr", "s")]


@pytest.mark.parametrize("rows", [MANY + ODD, MANY[:1], MANY[:2], [MANY[0]] * 9, MANY[3:700:7]], ids=["many", "one", "two", "equal", "language"])
def test_manifest_equals_brute_force(spark, rows):
    found = merkle.manifest(_docs(spark, rows), F.col("doc_id") % 3 == 0).drop("proof").collect()
    assert sorted(map(_key, found)) == sorted(map(_key, _manifest(rows)))


def test_manifest_shares_upper_runs_by_block(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    monkeypatch.setattr(merkle, "CLIMB", merkle.CLIMB.replace("c.level > 4", "c.level > 1"))
    found = merkle.manifest(_docs(spark, MANY), F.col("doc_id") % 3 == 0).drop("proof").collect()
    assert sorted(map(_key, found)) == sorted(map(_key, _manifest(MANY)))


def test_manifest_proof_is_what_verifies_a_leaf(spark):
    rows = merkle.manifest(_docs(spark, MANY[:3]), F.lit(False)).collect()
    assert all(r["verified"] for r in rows)
    assert {len(r["proof"]) for r in rows} == {2 * 32}


def _sets(rows):
    out = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        out.append(frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset())
    return out


def _components(rows):
    found, root = _sets(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(found):
        for j in range(i):
            same = len(a & found[j])
            if a and found[j] and 100 * same >= 85 * (len(a) + len(found[j]) - same):
                root[top(i)] = top(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((_key((r[0], len(found[i]), r[0] if not found[i] else least.get(top(i)))) for i, r in enumerate(rows)))


def _near(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(f"p{i}" for i in range(40))
    base = [draw.choice(words) for _ in range(90)]
    texts = []
    for _ in range(60):  # near copies, some of them above and some below the limit
        own = list(base)
        for _ in range(draw.randrange(5)):
            own[draw.randrange(len(own))] = draw.choice(words)
        texts.append(" ".join(own))
    texts += [passage + " " + " ".join(draw.choice(words) for _ in range(draw.randrange(60))) for _ in range(60)]
    texts += [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 8))) for _ in range(40)]
    texts += ["one two", "One TWO", "a b c d", "A b\tc  d", "x", None, "", " \n\x0b", "é É", "é\x85x y z", texts[0] + " end", "long " * 30_000, " ".join(words * 40)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return rows + [(5, texts[0], "en", "s"), (None, texts[0], "en", "s"), (None, "only here by itself it stands", "en", "s"), rows[3], rows[3]]


@pytest.mark.parametrize("block", [256, 4])
def test_set_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "PART_ROWS", 16 if block == 4 else 1024)
    whole = ngram_join.mixed_groups
    monkeypatch.setattr(ngram_join, "mixed_groups", lambda grouped, edges: whole(grouped, edges, block))
    rows = _near(block)
    found = ngram_join.near_sets(_docs(spark, rows)).collect()
    assert sorted(map(_key, found)) == _components(rows)


def test_shingle_hashes_do_not_depend_on_what_is_hashed_with_them():
    texts = ["", "a", "a b c d e", "x " * 10, "b" * 500 + " c d e f", "a b c d e", None]
    data = [None if t is None else t.encode() for t in texts]
    alone = [ngram_join.shingle_sets([t])[0].tolist() for t in data]
    assert [own.tolist() for own in ngram_join.shingle_sets(data)] == alone
    assert [len(own) for own in alone] == [0, 1, 2, 1, 2, 2, 0]


def test_prefixes_of_linked_sets_share_what_they_ask_for():
    draw = np.random.default_rng(0)
    counts = draw.integers(1, 1000, ngram_join.COUNTERS)
    for _ in range(200):
        base = draw.integers(0, 1 << 63, int(draw.integers(1, 300)), dtype=np.uint64)
        other = np.concatenate([base[: len(base) - len(base) // 20], draw.integers(0, 1 << 63, len(base) // 20, dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        same = len(np.intersect1d(a, b))
        (least_a, first_a), (least_b, first_b) = (ngram_join.prefix(x, counts, 500.0) for x in (a, b))
        if 100 * same >= 85 * (len(a) + len(b) - same):
            assert len(np.intersect1d(first_a, first_b)) >= min(least_a, least_b)


def _mined(rows, anchors):
    fine = [r for r in dict.fromkeys((i, None if v is None else tuple(v), x) for i, v, x in rows) if r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) == 6 and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = [np.floor(256 * np.array(v)).astype(int) for _, v, _ in fine]
    out = []
    for a, (anchor, _, label) in enumerate(fine):
        if not anchors(anchor):
            continue
        score = [int(whole[a] @ w) for w in whole]
        order = sorted((n for n in range(len(fine)) if n != a), key=lambda n: (-score[n], fine[n][0]))
        for p in [n for n in order if fine[n][2] == label][:5]:
            near = [n for n in order if fine[n][2] != label and 30 * score[p] <= 100 * score[n] <= 90 * score[p]][:10]
            out += [(anchor, fine[p][0], rank, fine[n][0], score[p], score[n]) for rank, n in enumerate(near, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int, row string, x string, score string"


def _vectors(seed, n=600):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(8, 6))
    rows = [(i, (centres[draw.integers(8)] + 0.4 * draw.normal(size=6)).round(2).tolist(), int(draw.integers(4))) for i in range(n)]
    rows += [(n + i, rows[40][1], i % 3) for i in range(200)]  # many copies
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 6, 1), (2003, [float("nan")] * 6, 1), (2004, [None] * 6, 1), (2005, [1.0] * 5, 1), (None, rows[3][1], 1), (2006, rows[3][1], None)]
    return rows + [rows[10], rows[10]]


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_brute_force(spark, seed):
    rows = _vectors(seed)
    df = spark.createDataFrame([(i, v, x, "r", "x", "s") for i, v, x in rows], VECTORS).repartition(3)
    found = hard_negatives.mine(df, F.col("label"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, found)) == _mined(rows, lambda i: i % 20 == 0)


def test_hard_negatives_of_large_numbers_are_exact(spark):
    rows = [(i, [float(2**17 + 3 * i * j + 0.25) for j in range(6)], i % 2) for i in range(80)]
    df = spark.createDataFrame([(i, v, x, "r", "x", "s") for i, v, x in rows], VECTORS)
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("label"), F.col("vec_id") % 20 == 0).collect())) == _mined(rows, lambda i: i % 20 == 0)
    with pytest.raises(ValueError, match="long"):
        hard_negatives.mine(df.withColumn("embedding", F.transform("embedding", lambda v: v * 1e12)), F.col("label"), F.lit(True))


def test_the_levels_of_a_cover_tree_cover():
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.integers(-200, 200, (900, 5)), np.repeat(draw.integers(-200, 200, (1, 5)), 400, axis=0)])
    norm = float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max()))
    tree = hard_negatives.CoverTree(x, norm)
    assert sorted(tree.rows.tolist()) == list(range(len(x)))
    centres, radii, _ = tree.levels[-1]
    start = 0
    for centre, radius, end in zip(centres, radii, tree.ends, strict=True):
        far = np.sqrt(((hard_negatives.lift(x[tree.rows[start:end]], norm) - hard_negatives.lift(centre[None], norm)) ** 2).sum(axis=1))
        assert far.max() <= radius
        start = end
    assert len(tree.levels) > 2


EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string"


def _folded(events):
    acc = []
    for _, _, kind, turn, role, text in sorted(events, key=lambda e: (e[1], e[3], e[2] or "", e[4] or "", e[5] or "")):
        at = next((i for i, m in enumerate(acc) if m[0] == turn), None)
        text = "" if kind == "regenerate" else text or ""
        if kind == "message" or kind in ("delta", "edit", "regenerate") and at is None:
            acc.append([turn, role or "", text])
        elif kind == "delta":
            acc[at][2] += text
        elif kind in ("edit", "regenerate"):
            acc[at][2] = text
            del acc[at + 1 :]
    return [tuple(m) for m in acc]


def test_fold_equals_a_loop_over_events(spark):
    draw, rows = random.Random(3), []
    kinds = ["message", "delta", "delta", "delta", "edit", "regenerate", "other", None]
    for conv in range(120):
        for seq in range(draw.randrange(1, 40)):
            rows.append((conv, seq if draw.random() < 0.9 else 5, draw.choice(kinds), draw.randrange(6), draw.choice(["user", "assistant", None]), draw.choice(["a", "b", None])))
    rows += rows[:50]  # repeated events
    found = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in chat.fold(spark.createDataFrame(rows, EVENTS)).collect()}
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    assert found == {conv: _folded(events) for conv, events in by.items()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert merkle.manifest(none, F.lit(True)).count() == 0
    assert ngram_join.near_sets(none).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("label"), F.lit(True)).count() == 0
    blank = _docs(spark, [(1, None, None, None), (None, "", None, None)])
    assert sorted(map(_key, ngram_join.near_sets(blank).collect())) == sorted(map(_key, [(1, 0, 1), (None, 0, None)]))


@pytest.mark.parametrize(
    "source, nodes", [("<a " * 350_000, 2), ("<a '" * 260_000, 2), ("<a '" * 260_001 + ">", 2), ("<div>" * 100_000, 100_001), ("<center>" * 50_000 + "</table>" * 50_000, 50_001)]
)
def test_pages_take_time_in_proportion_to_their_length(source, nodes):
    start = time.process_time()
    page = main_text.parse(source)
    assert len(page.tags) <= nodes
    main_text.Forest([page], {})
    assert time.process_time() - start < 5


def test_tags_end_where_their_quotes_allow():
    for source, texts in (("<a b='>'>x", ["x"]), ("<a b=\"'>y", ["<a b=\"'>y"]), ("<a 'b>c' d>e", ["e"]), ("1 < 2 <b>3", ["1 < 2 3"]), ("<!x>y", ["y"]), ("<!-- a > b -->c", ["c"])):
        assert [t for t in main_text.parse(source).texts if t] == texts, source


def test_postings_are_sent_once_to_their_tokens(spark, monkeypatch):
    rows = [(i, f"a b c d e f g h i j k l m n o {i % 4}", "en", "s") for i in range(12)]
    plans, made = {}, ngram_join.materialise

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return made(df, label)

    monkeypatch.setattr(ngram_join, "materialise", kept)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_sets(_docs(spark, rows)).collect()}
    assert got == {i: 0 for i in range(12)}
    assert plans["shingle-buckets"].count("hashpartitioning(token") == 1


def test_classes_need_no_join_and_unneeded_texts_are_not_sent(spark, monkeypatch):
    near = [f"a b c d e f g h i j k l m n o p q r s t u v w x y z {i}" for i in range(3)]
    rows = [(i, near[i % 3], "en", "s") for i in range(9)] + [(9 + i, " ".join(f"w{i}_{j}" for j in range(20)), "en", "s") for i in range(30)]
    made, sent = ngram_join.materialise, {}

    def kept(df, label):
        out = made(df, label)
        sent[label] = out
        return out

    monkeypatch.setattr(ngram_join, "materialise", kept)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_sets(_docs(spark, rows)).collect()}
    assert got == {i: 0 if i < 9 else i for i in range(39)}
    assert "shingle-members" not in sent
    assert "c" not in sent["shingle-prints"].columns
    # One row for each class and shingle, however many copies there are in how many tasks.
    buckets = sent["shingle-buckets"]
    assert buckets.count() == buckets.select("token", "band", "c").distinct().count()
    assert sent["shingle-texts"].select("c").distinct().count() == 3


def test_classes_of_one_number_get_another_salt(spark, monkeypatch):
    own, salts = ngram_join.class_of, []

    def clashing(salt):
        salts.append(salt)
        return F.lit(7).cast("long") if salt == 0 else own(salt)

    monkeypatch.setattr(ngram_join, "class_of", clashing)
    rows = [(i, " ".join(f"w{i // 2}_{j}" for j in range(20)), "en", "s") for i in range(6)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_sets(_docs(spark, rows)).collect()}
    assert got == {i: i // 2 * 2 for i in range(6)} and set(salts) == {0, 1}
