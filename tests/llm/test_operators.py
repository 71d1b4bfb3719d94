"""Operators on small tables with every edge case, against brute force; and on empty tables."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import chat, language, line_quality, main_text, mixing, near_duplicates, neighbours, packing, quality_rules, queries, token_files, tokens

SF = "/root/testdata/sf0.001"
# Extra columns have the names of results and of inner columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, _hash string, target string, predicted string, fp string, taken string"


def _texts():
    draw = random.Random(0)
    words = ["the", "and", "house", "water", "near", "tree", "stone", "of", "light", "river"]
    out = []
    for i in range(40):
        out.append((i, " ".join(draw.choice(words) + str(draw.randrange(40)) for _ in range(draw.randrange(1, 60)))))
    near = " ".join(f"w{i}" for i in range(200))
    out += [(100, near), (101, near), (101, near), (102, near + " end"), (103, "x " + near), (104, near.upper())]
    out += [(105, None), (106, ""), (107, " \n\t\x0b"), (None, "a lonely text of some words"), (None, None), (108, "!!! 123"), (109, "Größe  füge\x85zu"), (110, "long " * 30_000)]
    return out


def _rows(texts):
    langs, sources = ["en", "de", None], ["a", "b", None, "ä"]
    return [(i, t, langs[n % 3], sources[n % 4], None if t is None else len(t), "s", "z", "h", "t", "p", "f", None) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(_texts()), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def key(value):
    return (value is None, value)


def test_near_duplicates_equal_brute_force(docs):
    found = near_duplicates.near_duplicates(docs).collect()
    texts = _texts()
    prints = [near_duplicates.fingerprint(None if t is None else t.encode()) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for n, (i, _) in enumerate(texts):
        least[find(n)] = min(least.get(find(n), (True, None)), key(i), key=lambda k: (k[0], k[1] or 0))
    want = sorted(((key(i), f"{p:016x}", key(least[find(n)][1])) for n, ((i, _), p) in enumerate(zip(texts, prints, strict=True))), key=str)
    assert sorted(((key(r["doc_id"]), r["fingerprint"], key(r["component_id"])) for r in found), key=str) == want
    kept = near_duplicates.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((k[1] for k in least.values()), key=str)


def test_hot_buckets_are_split_without_loss(spark):
    draw = random.Random(5)
    base = draw.getrandbits(64)
    prints = sorted({base ^ sum(1 << draw.randrange(40) for _ in range(draw.randrange(5))) & (2**64 - 1) for _ in range(150)})
    nodes = spark.createDataFrame([(near_duplicates._signed(p),) for p in prints], "fp long")

    def components(block):
        edges = near_duplicates.links(nodes, 3, block)
        return {r["node"]: r["root"] for r in near_duplicates.components(edges).collect()}

    whole, split = components(2048), components(16)
    assert whole == split
    linked = {p for p in prints if any(p != q and (p ^ q).bit_count() <= 3 for q in prints)}
    assert set(whole) == {near_duplicates._signed(p) for p in linked}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 900)], "u long, v long")
    found = {r["node"]: r["root"] for r in near_duplicates.components(edges).collect()}
    assert found == {i: 0 for i in range(301)} | {900: 900, 1000: 900}


def _mixed(rows, weights=(5, 2, 1), most=3):
    sizes = {}
    for _, text, _, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while True:
        left, shares = total - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / shares > most * sizes[s]}
        if not over:
            return sizes, target | {s: left * weight[s] / shares for s in free}
        target |= {s: float(most * sizes[s]) for s in over}
        free -= over


def test_mix_meets_its_targets(docs):
    rows = _rows(_texts())
    sizes, target = _mixed(rows)
    for bucket_rows in (4096, 5):
        found = mixing.mix(docs, bucket_rows=bucket_rows).collect()
        assert len(found) == len(rows)
        for source in sizes:
            own = [r for r in found if r["source"] == source]
            assert {r["source_size"] for r in own} == {sizes[source]}
            assert own[0]["target"] == pytest.approx(target[source])
            assert abs(sum(r["taken"] for r in own) - target[source]) <= 5  # ties share the border
            epochs = {r["taken"] // r["size"] for r in own if r["size"]}
            assert max(epochs) - min(epochs) <= 1  # complete epochs come first
            assert all(r["taken"] <= 3 * r["size"] for r in own)
    assert mixing.repeat(docs).columns == docs.columns


@pytest.mark.parametrize("weights, total", [((97, 203), 10), ((197, 103), 20), ((103, 197), 10)])
def test_mix_takes_the_epoch_just_above_its_target(spark, weights, total):
    rows = [(i, "a b", "a") for i in range(5)] + [(10 + i, "a b c d", "b") for i in range(5)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights).where("source = 'a'").collect()
    assert sum(r["taken"] for r in found) == total


def test_mix_equals_its_sql_just_below_a_whole_source(spark):
    rows = [(1, "a b", "a"), (2, "c", "a"), (3, "d", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    found = mixing.mix(docs).select("doc_id", "taken").collect()
    assert sorted(map(tuple, found)) == sorted((r[0], r[-1]) for r in con.execute(queries.OP1).fetchall()) == [(1, 2), (2, 1), (3, 1)]


def test_quality_rules(docs):
    found = quality_rules.judge(docs, ["doc_id", "text"]).collect()
    assert len(found) == docs.count()
    for r in found:
        want = quality_rules.count(None if r["text"] is None else r["text"].encode())
        assert {k: r[k] for k in quality_rules.COUNTS} == want
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_language(docs):
    found = language.identify(docs, docs.columns).collect()
    assert len(found) == docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in found if not any(map(str.isalpha, r["text"] or "")))
    assert all(r["lang_pred"] in ("en", "de") and 0 <= r["score"] <= 1 for r in found if any(map(str.isalpha, r["text"] or "")))
    assert language.keep_known(docs).columns == docs.columns


def test_language_is_right_on_held_out_documents(spark):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(whole, ["doc_id", "lang"]).where("crc32(cast(doc_id AS string)) % 4 = 2").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)


def test_every_language_is_learned(spark):
    draw = random.Random(0)
    say = lambda words, n: " ".join(draw.choice(words) for _ in range(n))
    english, latin = "the house near water and stone of light".split(), "aqua et lapis prope domum lucis".split()
    rows = [(1, "\n".join(say(english, 12) for _ in range(20_000)), "en")]  # one document with many lines
    rows += [(10, say(latin, 8), "la")] * 30  # copies
    rows += [(20 + i, "今日は天気がいいですね\n明日もいいでしょう", "ja") for i in range(3)]  # no blanks
    rows += [(30 + i, "Talo\nVesi", "fi") for i in range(3)] + [(40, "1 2 3 4\n!", "none"), (41, None, "none")]  # single words; no letters
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lines = language.sample(frame, F.col("lang"), lines=100)
    counts = {name: sum(1 for other, _ in lines if other == name) for name, _ in lines}
    assert counts == {"en": 100, "la": 1, "ja": 6, "fi": 6}
    model = language.fit(frame, F.col("lang"), lines=100)
    found = language.predict(frame, model, ["lang"]).where("lang <> 'none'").distinct().collect()
    assert {r["lang"]: r["lang_pred"] for r in found} == {name: name for name in counts}
    few = language.sample(frame.where("lang = 'fi'"), F.col("lang"), per_language=1, lines=1)
    assert [name for name, _ in few] == ["fi"]


def test_line_quality(docs, labels, spark):
    found = line_quality.classify(docs, labels, docs.columns)
    assert found.count() == docs.count() and {"score", "predicted"} <= set(found.columns)
    assert line_quality.keep_good(docs, labels).columns == docs.columns
    whole, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = line_quality.classify(whole, marks, ["doc_id"]).where("crc32(cast(doc_id AS string)) % 5 = 0").join(marks, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def _check_packing(found, texts, capacity):
    encode = tokens.Encoder(tokens.default_path()).whole
    want = []
    for i, t in texts:
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(key(i), n, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for n, at in enumerate(range(0, len(ids), capacity))]
    assert sorted(((key(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=str) == sorted(want, key=str)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r["length"] for r in found)
    assert len(sequences) <= -(-total // capacity) + 2


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(docs, capacity):
    _check_packing(packing.pack(docs, capacity=capacity).collect(), _texts(), capacity)


def test_token_files(docs, spark, tmp_path):
    token_files.write_files(docs, str(tmp_path / "files"), segment=500)
    found = token_files.read_files(spark, str(tmp_path / "files"), with_ids=True).collect()
    encode = tokens.Encoder(tokens.default_path()).whole
    rows = sorted(((i, t) for i, t in _texts()), key=lambda r: (r[0] is not None, r[0] or 0))
    found.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [i for i, _ in rows]
    before = 0
    for r in found:
        assert r["start"] == before and r["n_tokens"] == len(r["ids"])
        before += r["n_tokens"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    want = sorted([*encode.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows)
    assert sorted(r["ids"] for r in found) == want


EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string"


def test_chat_folds_events(spark):
    log = [
        (1, 0, "message", 0, "user", "hi <|end|> \\ <\\|x"), (1, 1, "delta", 1, "assistant", "he"), (1, 2, "delta", 1, "assistant", "llo"),
        (1, 3, "message", 2, "user", "more"), (1, 4, "edit", 0, "user", "hi!"), (1, 5, "delta", 1, "assistant", "new"),
        (1, 6, "regenerate", 1, "assistant", None), (1, 7, "delta", 1, "assistant", "[INST] end </s>"),
        (None, 0, "message", 0, None, None), (2, 1, "message", 1, "assistant", "b"), (2, 0, "message", 0, "assistant", "a"),
    ]
    random.Random(0).shuffle(log)
    rendered = chat.render(chat.fold(spark.createDataFrame(log, EVENTS).repartition(3)))
    back = {r["conv_id"]: [(m["role"], m["text"]) for m in r["messages"]] for r in chat.read_back(rendered).collect()}
    assert back == {1: [("user", "hi!"), ("assistant", "[INST] end </s>")], None: [("", "")], 2: [("assistant", "a"), ("assistant", "b")]}
    digests = {r["conv_id"]: r for r in chat.digests(rendered).collect()}
    assert digests[2]["loss_chars"] == 2 and digests[None]["loss_chars"] == 0 and digests[1]["n_turns"] == 2
    formatted = {r["conv_id"]: r["formatted"] for r in rendered.collect()}
    assert formatted[2] == "<|turn|>assistant<|says|>a<|end|>\n<|turn|>assistant<|says|>b<|end|>\n"
    assert "</s>" not in formatted[1] and "[INST]" not in formatted[1]


def test_chat_escapes_are_reversible(spark):
    draw = random.Random(2)
    parts = ["<", "\\", "|", "s>", "/s>", "[", "INST]", "<|turn|>", "<|says|>", "<|end|>\n", "</s>", "<<SYS>>", "<</SYS>>", "a", "$1", "\n", "é"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(400)]
    rows = [(i, 0, "message", 0, t, t[::-1]) for i, t in enumerate(texts)]
    found = chat.read_back(chat.render(chat.fold(spark.createDataFrame(rows, EVENTS)))).collect()
    assert {r["conv_id"]: [(m["role"], m["text"]) for m in r["messages"]] for r in found} == {i: [(t, t[::-1])] for i, t in enumerate(texts)}


def test_neighbours_with_odd_vectors(spark):
    draw = np.random.default_rng(0)
    rows = [(i, (3 * draw.normal(size=8)).round().tolist()) for i in range(200)]
    rows += [(200 + i, rows[40][1]) for i in range(60)]  # many copies
    rows += [(20, rows[20][1]), (300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [None] * 8), (305, [1.0] * 5), (None, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    found = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vectors = {i: np.array(v) for i, v in rows[:260]}
    assert set(found) == {i for i in vectors if i % 20 == 0}
    for query, hits in found.items():
        scores = sorted(((-round(float(vectors[query] @ v), 9), i) for i, v in vectors.items() if i != query))[:20]
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21))
        assert [(-round(h[2], 9), h[1]) for h in hits] == scores


def test_neighbours_reach_their_recall(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 16))
    matrix = (centres[draw.integers(0, 40, 4000)] + 0.3 * draw.normal(size=(4000, 16))) * draw.uniform(0.5, 2, (4000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for query, own in found.items():
        scores = matrix @ matrix[query]
        scores[query] = -np.inf
        hits += len(own & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * 200


def test_main_text(spark):
    pages = [(1, "u", "<article><p>One &amp; two</article>", "x"), (2, None, None, "x"), (2, None, None, "x"), (3, "v", "", None)]
    found = main_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string"), ["page_id", "url", "text"]).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in found) == [(1, "One & two", 9), (2, "", 0), (2, "", 0), (3, "", 0)]


def test_copies_of_pages_train_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(main_text, "train", seen.extend)
    monkeypatch.setattr(main_text, "labelled", list)
    pages = spark.range(40_000).select(F.when(F.col("id") < 20, F.concat(F.lit("<p>one "), F.col("id"))).otherwise(F.concat(F.lit("<p>"), F.col("id") % 10)).alias("html"))
    main_text.fit(pages)
    assert sorted(seen) == sorted([f"<p>{i}" for i in range(10)] + [f"<p>one {i}" for i in range(20)])


def test_main_text_of_given_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in main_text.main_text(pages, ["page_id", "html"]).collect():
        inner = re.search("<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_empty_tables(empty, labels, spark):
    assert near_duplicates.near_duplicates(empty).count() == 0
    assert near_duplicates.keep_first(empty).columns == empty.columns
    assert mixing.mix(empty).count() == 0
    assert quality_rules.judge(empty, ["doc_id"]).count() == 0
    assert language.identify(empty, ["doc_id"]).count() == 0
    assert line_quality.classify(empty, labels.limit(0), ["doc_id"]).count() == 0
    assert packing.pack(empty).count() == 0
    assert token_files.round_trip(empty).count() == 0
    assert chat.digests(chat.render(chat.fold(spark.createDataFrame([], EVENTS)))).count() == 0
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert main_text.main_text(spark.createDataFrame([], "page_id long, html string"), ["page_id"]).count() == 0


def test_pipeline_stages(docs, empty, spark, tmp_path):
    for start in (docs, empty):
        now = start
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{start.count()}-{n}")
            stage(spark, now, SF).write.parquet(path)
            now = spark.read.parquet(path)
            if name != "packing":
                assert now.columns == start.columns
        assert {"sequence_id", "offset", "length"} <= set(now.columns)


def test_pipeline_stages_equal_their_operators(spark):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in whole.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, whole, "").collect()}
    prints = {i: near_duplicates.fingerprint(t.encode()) for i, t in texts.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert kept == {find(i) for i in ids}
    mixed = {r["doc_id"]: r["n"] for r in corpus_pipeline.STAGES[3][1](spark, whole, "").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in mixing.mix(whole).collect():
        assert abs(mixed.get(r["doc_id"], 0) * r["size"] - r["taken"]) <= r["size"] / 2


def test_queries_have_the_columns_of_their_contracts():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)
