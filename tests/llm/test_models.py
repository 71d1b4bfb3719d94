"""Parts without Spark against brute force."""

import html
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from recordloom.llm import crf, language, line_quality, main_text, near_duplicates, packing, quality_rules, range_coder, tokens


@pytest.mark.parametrize("segment", [2, 3, 32])
def test_marginals_equal_enumeration(monkeypatch, segment):
    monkeypatch.setattr(crf, "SEGMENT", segment)
    draw = np.random.default_rng(0)
    emit, trans = draw.normal(size=(7, 3)), draw.normal(size=(3, 3))
    found, expected = crf.marginals(emit, np.array([5, 0, 2]), trans, pairs=True)
    want, pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for low, n in ((0, 5), (5, 2)):
        total, each, both = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(sum(emit[low + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            total += p
            for i, y in enumerate(path):
                each[i, y] += p
            for a, b in itertools.pairwise(path):
                both[a, b] += p
        want[low : low + n] = each / total
        pairs += both / total
    assert np.allclose(found, want) and np.allclose(expected, pairs)


def test_covering_masks_leave_out_any_three_positions():
    masks = near_duplicates.masks(3)
    assert len(masks) == 15
    for places in itertools.combinations(range(64), 3):
        differ = sum(1 << i for i in places)
        assert any(not differ & m for m in masks)


def test_fingerprint_counts_bits():
    import xxhash

    text = "Ein Wort zwei\x0bWORT drei vier ÄÖ wort zwei wort drei"
    words = [w for w in re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert near_duplicates.fingerprint(text.encode()) == want
    assert near_duplicates.fingerprint(b"Two Words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert near_duplicates.fingerprint(None) == near_duplicates.fingerprint(b" \n\t") == 0


def test_forest_connects_what_is_near():
    draw = random.Random(1)
    base = draw.getrandbits(64)
    nodes = {base ^ sum(1 << draw.randrange(12) for _ in range(draw.randrange(6))) & ((1 << 64) - 1) for _ in range(60)}
    signed = np.array([near_duplicates._signed(x) for x in nodes], np.int64)

    def classes(edges):
        root = {x: x for x in signed.tolist()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        groups = {}
        for x in root:
            groups.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    every = [(a, b) for a, b in itertools.combinations(signed.tolist(), 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3]
    forest = list(near_duplicates._forest(signed, 3))
    assert classes(forest) == classes(every)
    assert len(forest) < len(signed)


def _fewest(sizes, capacity):
    """Smallest number of bins, by trying all."""
    best = len(sizes)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                put(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        put(i + 1, [*bins, sizes[i]])

    put(0, [])
    return best


def test_packing_plan_is_whole_and_reduction_loses_nothing():
    draw = random.Random(3)
    for _ in range(150):
        capacity = draw.choice([10, 20, 30])
        sizes = sorted((draw.randint(1, capacity) for _ in range(draw.randint(0, 9))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        fixed, rest = packing.reduce_instance(counts, capacity)
        got = dict(rest)
        for content, n in fixed:
            assert sum(length * times for length, times in content) <= capacity
            for length, times in content:
                got[length] = got.get(length, 0) + times * n
        assert got == counts
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + _fewest(left, capacity) == _fewest(sizes, capacity)  # the reduction is optimal
        plan = packing.plan(counts, capacity)
        assert sum(n for _, n in plan) <= _fewest(sizes, capacity) + 1


def test_best_fit_of_many_equal_lengths():
    plan = packing.plan({1000: 1_000_000, 96: 1_000_000, 4096: 5, 1: 10**9})
    total = {}
    for content, n in plan:
        assert sum(length * times for length, times in content) <= 4096
        for length, times in content:
            total[length] = total.get(length, 0) + n * times
    assert total == {1000: 1_000_000, 96: 1_000_000, 4096: 5, 1: 10**9}


@pytest.mark.parametrize(
    "ids",
    [[], [7], [2**32 - 1, 0, 5, 5, 5], [3] * 5000, list(range(3000)) * 2, np.random.default_rng(0).zipf(1.3, 9000) % 49408, np.random.default_rng(1).integers(0, 2**32, 2500)],
)
def test_range_coder_round_trip(ids):
    ids = np.asarray(ids, np.int64)
    data = range_coder.encode(ids)
    assert (range_coder.decode_many([data, data])[1] == ids).all()
    if len(ids) > range_coder.BLOCK:
        assert (range_coder.decode_block(data, 1) == ids[range_coder.BLOCK : 2 * range_coder.BLOCK]).all()


def test_range_coder_gains_and_checks():
    ids = np.tile(np.random.default_rng(0).integers(0, 50, 300), 30)
    data = range_coder.encode(ids)
    assert len(data) < len(ids) / 2  # a quarter of two bytes an id
    broken = bytearray(data)
    broken[-5] ^= 64
    with pytest.raises(ValueError, match="checksum"):
        range_coder.decode_many([bytes(broken)])


def test_encoder_equals_the_library():
    encode = tokens.Encoder(tokens.default_path())
    odd = [
        "", " ", "The, the. THE don't we'll IT'S 'S 'x <|endoftext|> a<|startoftext|>b", "ÀÉ x×y ÷ ſ K Å é İstanbul ΣΑΣ ΟΔΟΣ. \x1c\x1d \x85 \xa0  x　y 12 345 a1b2 中文字 🙂🙂 ́a é ≮",
        "\x00\x01 \x0b\x0c\x0d x", "</s>[INST] ok [/INST] it's 'tis a-b_c !!?? ß SS ﬁ ǅ a., b,. ..", "wort " * 3000, "z" * 5000,
    ]
    want = encode.whole.encode_batch(odd, add_special_tokens=False)
    for _ in range(2):
        found = encode.raw([t.encode() for t in odd])
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == [w.ids for w in want]
    assert encode.raw([None]) == [b""]


def test_repeated_words_equal_brute_force():
    draw = random.Random(0)
    for _ in range(200):
        words = [draw.choice([b"a", b"b"]) for _ in range(draw.randint(0, 40))]
        places = {}
        for i in range(len(words) - 7):
            places.setdefault(tuple(words[i : i + 8]), []).append(i)
        want = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(8)}
        assert quality_rules.repeated_words(words) == len(want)


def test_counts_of_a_text():
    found = quality_rules.count("One two|\n\n  \nOne two|\nÄ <b>\x0b#x\nOne two|".encode())
    assert {k: found[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines")} == {"n_words": 9, "word_chars": 3 * 7 + 1 + 3 + 2, "n_symbols": 6, "n_dup_lines": 2}
    assert quality_rules.count(None)["n_words"] == 0


def test_em_finds_rates_of_drawn_votes():
    draw = np.random.default_rng(0)
    rates = {0: [0.5, 0.6, 0.4, 0.5], 1: [0.02, 0.01, 0.03, 0.02]}  # bad votes by class
    patterns = {}
    for _ in range(20000):
        good = int(draw.random() < 0.8)
        p = "".join("0" if draw.random() < 0.2 else "-" if draw.random() < r else "+" for r in rates[good])
        patterns[p] = patterns.get(p, 0) + 1
    posterior, found, share = quality_rules.fit(patterns)
    assert abs(share - 0.8) < 0.05
    assert posterior["++++"] > 0.9 > 0.1 > posterior["----"]
    assert all(found[j, 0, 0] > 5 * found[j, 1, 0] for j in range(4))
    assert quality_rules.fit({})[0] == {}


def test_language_labels_words_of_mixed_text():
    draw = random.Random(0)
    voices = {"xx": ["ka", "ko", "ki"], "yy": ["ul", "ol", "il"]}
    lines = []
    for i in range(300):
        lang = "xx" if i % 2 else "yy"
        lines.append((lang, ["".join(draw.choice(voices[lang]) for _ in range(draw.randint(1, 4))) for _ in range(12)]))
    model = language.train(lines)
    found = model.label([["kaka", "kiko", "ulil", "olul", "iliol"], []])
    assert [model.langs[k] for k in found[0].argmax(axis=1)] == ["xx", "xx", "yy", "yy", "yy"]
    assert language.words_of("Ab1c _dé! 12") == ["ab", "c", "dé"]
    assert language.train([]).langs == []


def test_line_quality_learns_and_takes_empty_texts():
    draw = random.Random(0)
    words = ["the", "house", "stands", "near", "water", "and", "trees"]
    rows = []
    for i in range(200):
        good = i % 3 > 0
        lines = [" ".join(draw.choice(words) for _ in range(12)) + "." for _ in range(draw.randint(1, 5))]
        text = "\n".join(lines) if good else "\n".join(x.upper() + "!!" for x in lines)
        rows.append((line_quality.measures(text)[0], int(good)))
    model = line_quality.train(rows)
    texts = ["the trees and the water stand near.", "THE HOUSE!! WATER!! AND TREES!! NEAR!!", "", None]
    scores = model.scores([line_quality.measures(t) for t in texts])
    assert scores[0] > 0.8 and scores[1] < 0.2 and all(0 <= s <= 1 for s in scores)
    assert line_quality.train([]).scores([line_quality.measures("x")]) == [0.5]


@pytest.fixture(scope="module")
def page_model():
    return main_text.train(main_text.labelled([]))


def test_tree_marginals_equal_enumeration():
    page = main_text.parse("<div class=a><p>x</p><ul><li>y<li>z</ul></div><p>w")
    index = {f: i for i, f in enumerate(sorted({f for own in main_text.features(page) for f in own}))}
    draw = np.random.default_rng(0)
    weights, edges = draw.normal(size=len(index)), draw.normal(size=(2, 2, 2))
    forest = main_text.Forest([page], index)
    found, _ = forest.marginals(weights, edges)
    unary, n, total, mass = forest.unary(weights), len(page.tags), 0.0, np.zeros(len(page.tags))
    for labels in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(edges[forest.leaf[i], labels[up], labels[i]] for i, up in enumerate(page.parents) if up >= 0))
        total += p
        mass += p * np.array(labels)
    assert np.allclose(found, mass / total)


def test_main_text_of_unseen_markup(page_model):
    source = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
    <header><h2>Site name</h2></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><!-- <p>ad</p> -->
    <div class="cookie notice">We use cookies, accept.</div><article><h1>A &amp; B</h1><p><b>First   para&shy;graph, which is long enough.<br>Next&nbsp;line.
    <p>Short.<p>With <a href=/x>a link</a> inside &lt;it&gt; &am.</article><aside class=sidebar><p>Also read this.</p></aside>
    <section class="comments"><p>Reader says: nice.</p></section><form><p>Your name</p><select><option>x</select></form><footer>&copy; us</footer>"""
    want = ["A & B", "First para­graph, which is long enough. Next line.", "Short.", "With a link inside <it> &am."]
    assert page_model.extract([source, None, ""]) == ["\n".join(want), "", ""]


@pytest.mark.parametrize(
    "before",
    [
        "<html><body><datalist><option value=a><option value=b></datalist>",
        "<html><head><meta charset=utf-8><title>t</title>",
        "<html><head><title>t</title><script>x</script><link rel=x>",
        "<body><button>x",
        "<body><div><button>x</div>",
        "<body><button>x<button>y</button>",
        "<body><div><select><option>x<option>y</div>",
        "<body><select><option>x<select><p>",
        "<body><div><object><param name=x></div>",
        "<body><div><video src=x><source src=y></div>",
        "<body><p><video src=x>",
        "<body><svg><path d=x>",
        "<body><div><svg><style/><path/></svg></div>",
        "<body><div><template>x</div>",
        "<body><table><tr><td><button>x<td><option>y</table>",
        "<body><ul><li><option>x<li></ul>",
        "<body><label><option>x</label>",
    ],
)
def test_omitted_end_tags_lose_no_text(before):
    page = main_text.parse(f"{before}<article><h1>One</h1><p>Two <b>three</b>.</p></article><p>Four</p>")
    assert [t for t in page.texts if t] == ["One", "Two three.", "Four"]


def test_what_is_skipped_stays_skipped():
    source = (
        "<html><head> <title>a</title> </head><body><p>One<button>a<div>b</div>c</button> two</p><select><optgroup><option>a<option>b</select>"
        "<template><p>a</div></p></template><svg><foreignObject><div>a</div></foreignObject><text>b</text></svg>"
        "<object><object><p>a</p></object>b</object><video><p>a</p></video><p>Three"
    )
    assert [t for t in main_text.parse(f"<div>{source}").texts if t] == ["One two", "Three"]
    assert [t for t in main_text.parse("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.").texts if t] == ["Let x=1 hold."]
    assert [t for t in main_text.parse("<head>Some text <b>here</b>").texts if t] == ["Some text here"]


def test_main_text_of_held_out_variants(page_model):
    draw = random.Random(99)
    right = 0
    for i in range(60):
        marked = main_text._variant([f"Title {i}", "A paragraph of the text, as long as usual.", "Short one.", "And the last of them, here."], ["Read more now.", "Some words of a reader, who liked it."], draw)
        page = main_text.parse(marked)
        want = "\n".join(t for t, good in zip(page.texts, main_text.labels(page), strict=True) if t and good)
        right += page_model.extract([re.sub(" data-(keep|drop)", "", marked)]) == [want]
    assert right >= 54


def test_crc_of_ids_and_sizes():
    from recordloom.llm.common import _size, crc_of

    assert [_size(x) for x in ("512", "64m", "67108864b", "2kb")] == [512, 64 << 20, 64 << 20, 2048]

    assert crc_of(np.array([1, 70000])) == zlib.crc32(b"\1\0\0\0" + (70000).to_bytes(4, "little"))
    assert html.unescape("&am") == "&am"
