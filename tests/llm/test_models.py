"""Codecs, matchers and models against brute force, round trips and held-out rows."""

import random
import struct


import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- progressive JPEG


def test_payloads_come_back():
    from laneweave.llm import progressive_jpeg as jpeg

    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 384, 385, 5000, 100_000):
        data = jpeg.padded(rng.integers(0, 256, n, dtype=np.uint8).tobytes())
        assert len(data) % 64 == 0 and len(data) >= 64
        got = jpeg.decode(jpeg.encode(data))
        assert got.payload() == data
        picture = got.rgb()
        assert picture.shape == (got.height, got.width, 3) and picture.dtype == np.uint8


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in reversed(range(n))]

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def reference_jpeg(blocks, al, restart=0, bands=((1, 9), (10, 63))):
    """A grey progressive JPEG of one block row, coded symbol by symbol with 8-bit codes, as the standard says."""
    from laneweave.llm import progressive_jpeg as jpeg

    n = len(blocks)
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\0" + bytes(range(1, 65))), jpeg._segment(0xC2, struct.pack(">BHHB", 8, 8, 8 * n, 1) + bytes([1, 0x11, 0]))]
    symbols = [*range(16)], [r << 4 | s for r in range(16) for s in range(11)]
    out.append(jpeg._segment(0xC4, jpeg._table(0, 0, {8: symbols[0]}) + jpeg._table(1, 0, {8: symbols[1]})))
    if restart:
        out.append(jpeg._segment(0xDD, struct.pack(">H", restart)))
    code = [{s: i for i, s in enumerate(x)} for x in symbols]

    def number(w, v, size):
        w.put(v if v >= 0 else v + (1 << size) - 1, size)

    def scan(ss, se, ah, body):
        parts = [body(blocks[i : i + restart]) for i in range(0, n, restart)] if restart else [body(blocks)]
        data = parts[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + p for i, p in enumerate(parts[1:]))
        out.append(jpeg._scan([(1, 0)], ss, se, ah, al if not ah else ah - 1, data))

    def dc(own):
        w, before = Bits(), 0
        for b in own:
            v = int(b[0]) >> al
            d, before = v - before, v
            size = abs(d).bit_length()
            w.put(code[0][size], 8)
            number(w, d, size)
        return w.bytes()

    def shifted(v):
        return int(np.sign(v)) * (abs(int(v)) >> al)

    def ac(ss, se):
        def body(own):
            w, waiting = Bits(), 0

            def flush():
                nonlocal waiting
                while waiting:
                    size = waiting.bit_length() - 1
                    w.put(code[1][size << 4], 8) if size < 16 else None
                    w.put(waiting - (1 << size), size)
                    waiting = 0

            for b in own:
                run = 0
                for k in range(ss, se + 1):
                    v = shifted(b[k])
                    if not v:
                        run += 1
                        continue
                    flush()
                    while run > 15:
                        w.put(code[1][0xF0], 8)
                        run -= 16
                    size = abs(v).bit_length()
                    w.put(code[1][run << 4 | size], 8)
                    number(w, v, size)
                    run = 0
                if run:
                    waiting += 1
            flush()
            return w.bytes()

        return body

    scan(0, 0, 0, dc)
    for ss, se in bands:
        scan(ss, se, 0, ac(ss, se))
    for level in range(al, 0, -1):
        low = level - 1

        def dc_more(own, low=low):
            w = Bits()
            for b in own:
                w.put(int(b[0]) >> low & 1, 1)
            return w.bytes()

        def ac_more(own, low=low):
            w = Bits()
            for b in own:
                held = [abs(int(v)) >> low for v in b]
                last = max((k for k in range(1, 64) if held[k] == 1), default=0)
                k, run, pending = 1, 0, []
                for k in range(1, 64):
                    if k > last:
                        break
                    if held[k] > 1:
                        pending.append(held[k] & 1)
                        continue
                    if held[k] == 0:
                        run += 1
                        if run == 16:
                            # sixteen zeros: only where a new coefficient follows
                            w.put(code[1][0xF0], 8)
                            for p in pending:
                                w.put(p, 1)
                            run, pending = 0, []
                        continue
                    w.put(code[1][run << 4 | 1], 8)
                    w.put(int(b[k] > 0), 1)
                    for p in pending:
                        w.put(p, 1)
                    run, pending = 0, []
                w.put(code[1][0], 8)
                for k in range(last + 1, 64):
                    if held[k] > 1:
                        pending.append(held[k] & 1)
                for p in pending:
                    w.put(p, 1)
            return w.bytes()

        out.append(jpeg._scan([(1, 0)], 0, 0, level, low, dc_more(blocks) if not restart else _joined(blocks, restart, dc_more)))
        out.append(jpeg._scan([(1, 0)], 1, 63, level, low, ac_more(blocks) if not restart else _joined(blocks, restart, ac_more)))
    return b"".join([*out, b"\xff\xd9"])


def _joined(blocks, restart, body):
    parts = [body(blocks[i : i + restart]) for i in range(0, len(blocks), restart)]
    return parts[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + p for i, p in enumerate(parts[1:]))


@pytest.mark.parametrize("al,restart", [(0, 0), (1, 0), (2, 0), (1, 2), (3, 3)])
def test_general_scans_decode(al, restart):
    from laneweave.llm import progressive_jpeg as jpeg

    rng = np.random.default_rng(al * 7 + restart)
    blocks = np.where(rng.random((7, 64)) < 0.2, rng.integers(-60, 61, (7, 64)), 0)
    blocks[3, 1:] = 0
    blocks[:, 0] = rng.integers(-200, 200, 7)
    got = jpeg.decode(reference_jpeg(blocks, al, restart))
    assert (got.planes[0].reshape(-1, 64) == blocks).all()
    with pytest.raises(ValueError):
        got.payload()


def test_pixels_against_the_transform_by_definition():
    from laneweave.llm import progressive_jpeg as jpeg

    rng = np.random.default_rng(3)
    blocks = rng.integers(-3, 4, (2, 64))
    blocks[:, 0] = rng.integers(-30, 30, 2)
    got = jpeg.decode(reference_jpeg(blocks, 1)).rgb()[:, :, 0].astype(int)
    table = np.arange(1, 65)
    for i, b in enumerate(blocks):
        f = np.zeros(64)
        f[jpeg.ZIGZAG] = b * table
        f = f.reshape(8, 8)
        c = lambda u: 0.5**0.5 if u == 0 else 1.0
        for y in range(8):
            for x in range(8):
                v = sum(c(u) * c(w) / 4 * f[w, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * w * np.pi / 16) for u in range(8) for w in range(8)) + 128
                assert abs(got[y, 8 * i + x] - np.clip(v, 0, 255)) <= 1


# ---------------------------------------------------------------- token files


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200))
@settings(max_examples=100, deadline=None)
def test_packing_round_trip(bits, values):
    from laneweave.llm import token_files as tf

    ids = np.array([v & ((1 << bits) - 1) for v in values], np.uint32)
    data = tf.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8) and (tf.unpack(data, bits, len(ids)) == ids).all()


def test_files_at_random():
    from laneweave.llm import token_files as tf

    rng = random.Random(2)
    docs = [[rng.randrange(50257) for _ in range(rng.choice([1, 3, 50]))] for _ in range(40)]
    ids = np.array([i for d in docs for i in d], np.uint32)
    for bits in (16, 17):
        held = tf.TokenFile(tf.file_bytes([None, *range(1, 40)], np.array([len(d) for d in docs]), ids, bits, 64))
        assert held.null_ids[0] and not held.null_ids[1:].any()
        for i in rng.sample(range(40), 40):
            assert held.document(i).tolist() == docs[i]
        assert held.ids(5, 200).tolist() == ids[5:200].tolist()
    assert tf.bits_for(50257) == 16 and tf.bits_for(65537) == 17


def test_words_kept_give_the_library_s_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    from laneweave.llm import token_files as tf

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), tf.WordCachedTokenizer(path)
    texts = pd.read_parquet(f"{SF}/documents.parquet").text.tolist()[:150]
    texts += ["", " ", "  a", "a  b", "a \n b\t c", "x<|endoftext|>y", "漢字 かな", "a b c", "\n\n a", "it's  we'll", "é́ x", "a\x1cb c"]
    for _ in range(2):
        assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


# ---------------------------------------------------------------- suffix automaton


def windows_hit(items, words, window):
    from laneweave.llm.decontaminate import words_of

    hit, found = set(), set()
    for item, text in items:
        own = words_of(text)
        n = min(window, len(own))
        for s in range(len(own) - n + 1 if own else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[s : s + n]:
                    hit.update(range(p, p + n))
                    found.add(item)
    return len(hit), sorted(found)


def test_automaton_against_all_windows():
    from laneweave.llm.decontaminate import Automaton

    rng = random.Random(5)
    for _ in range(1500):
        window, letters = rng.choice([2, 3, 4]), rng.choice(["ab", "abc", "abcd"])
        items = [(i, " ".join(rng.choice(letters) for _ in range(rng.randrange(9)))) for i in range(rng.randrange(6))]
        words = [rng.choice(letters + "e").encode() for _ in range(rng.randrange(25))]
        spans, found = Automaton(items, window).match(words)
        assert (sum(b - a for a, b in spans), sorted(found)) == windows_hit(items, words, window)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_repeated_items_are_one():
    from laneweave.llm.decontaminate import Automaton

    model = Automaton([("a", "x y"), ("b", "x y"), ("a", "q r"), ("a", "x y"), (None, "r")], 3)
    spans, found = model.match(b"x y z q r".split())
    assert spans == [(0, 2), (3, 5)] and sorted(map(str, found)) == ["None", "a", "b"]
    many = Automaton([(i % 3000, "w") for i in range(6000)] + [("long", "w " * 200)], 300)  # no state copies another's items
    assert sum(len(own) for entries in many.short for _, own in entries) == 3001
    assert len(many.match([b"w"] * 5)[1]) == 3000 and len(many.match([b"w"] * 200)[1]) == 3001


# ---------------------------------------------------------------- alignment and sketches


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_against_the_table():
    from laneweave.llm import order_minhash as om

    rng = random.Random(6)
    for n in range(800):
        a = [rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randrange(40))]
        b = list(a) if n % 4 else [rng.randrange(5) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(20)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = [rng.randrange(50)] * rng.randrange(2)
        limit = rng.randrange(30)
        true = edit_distance(a, b)
        assert om.distance_within(np.array(a, np.uint32), np.array(b, np.uint32), limit) == (true if true <= limit else None)


def test_sketches_see_order():
    from laneweave.llm import order_minhash as om

    words = np.arange(200, dtype=np.uint32)
    assert om.sketch(np.empty(0, np.uint32)) is None
    assert (om.sketch(words) == om.sketch(words)).all()
    swapped = np.concatenate([words[100:], words[:100]])
    assert (om.sketch(words) == om.sketch(swapped)).mean() < 0.75
    repeated = np.concatenate([words, words[:6]])  # a k-mer that occurs twice changes few sketches
    assert (om.sketch(words) == om.sketch(repeated)).mean() > 0.7
    assert len(om.sketch(words[:1])) == om.SKETCHES and (om.sketch(np.zeros(500, np.uint32)) == om.sketch(np.zeros(500, np.uint32))).all()


@pytest.mark.parametrize("even", [False, True])
def test_sketches_find_links_with_scattered_edits(even):
    from laneweave.llm import order_minhash as om

    rng = random.Random(41)
    found = links = 0
    for n, edits in [(200, 40), (200, 30), (60, 12), (60, 9), (50, 10), (41, 8), (40, 8), (33, 6), (30, 6), (20, 4), (15, 3), (10, 2), (8, 1), (6, 1), (5, 1)]:
        hits = 0
        for _ in range(100):
            a = [rng.randrange(1 << 32) for _ in range(n)]
            b = list(a)
            for at in [(2 * i + 1) * n // (2 * edits) for i in range(edits)] if even else rng.sample(range(n), edits):
                b[at] = rng.randrange(1 << 32)
            a, b = np.array(a, np.uint32), np.array(b, np.uint32)
            assert om.alike(a, b)
            ours, theirs = om.all_sketches(a), om.all_sketches(b)
            least = min(len(ours), len(theirs))
            hits += bool((ours[:least] == theirs[:least]).any())
        assert hits >= 93, (n, edits)
        found, links = found + hits, links + 100
    print("candidates", found, "of", links)
    assert found >= 0.985 * links


# ---------------------------------------------------------------- personal data


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


@given(st.text(alphabet="0123456789@.+-( )ab%", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans_against_plain_patterns(text):
    import re

    from laneweave.llm import pii

    digits = lambda s: re.sub("[^0-9]", "", s)
    expected = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    expected += [(m.start(), 1, m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    expected += [(m.start(), 2, m.end()) for m in re.finditer(CARD, text) if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    expected += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m.group())) <= 15]
    assert pii.base_spans(text) == sorted(expected)


@pytest.mark.parametrize("text", ["call +1 (017) 555-7713 x 9x", "call +1 (017) 555-7713 or x 0175557713 x 9x", "a 12345678 of b 7x and 12345678 c", "17 a 41-x b 41-x of +1 (017) 555-7713 d 0175557713"])
def test_marginals_against_all_labellings(text):
    from itertools import product

    from laneweave.llm import pii

    rng = np.random.default_rng(8)
    labels = len(pii.BASE) + 1
    field = pii.Field(rng.normal(size=(labels, pii.FEATURES)), *[rng.normal(size=(labels, labels)) for _ in range(3)])
    tokens = pii.Tokens(text, pii.base_spans(text))  # trees with their skip links, on which message passing is exact
    n = len(tokens.cores)
    own = np.array([pii.features(c) for c in tokens.cores]) @ field.unary.T
    total = np.zeros((n, labels))
    for ys in product(range(labels), repeat=n):
        if any(k >= 0 and y != k for y, k in zip(ys, tokens.clamped, strict=True)):
            continue
        score = sum(own[i, y] for i, y in enumerate(ys) if tokens.clamped[i] < 0) + sum(field.chain[ys[i - 1], ys[i]] for i in range(1, n) if tokens.near[i])
        score += sum((field.skip if max(tokens.clamped[i], tokens.clamped[j]) >= 0 else field.free)[ys[i], ys[j]] for i, j in tokens.links())
        for i, y in enumerate(ys):
            total[i, y] += np.exp(score)
    assert np.allclose(field.marginals(tokens), total / total.sum(axis=1, keepdims=True), atol=0.02)


# ---------------------------------------------------------------- words, rules, profiles


def plain_kernel(a: str, b: str) -> float:
    """Subsequences of three characters that both words hold within the window, by their definition."""
    from itertools import combinations

    from laneweave.llm import toxicity as tx

    def held(word):
        word = tx._BEGIN + word + tx._END
        found, norm = {}, 0.0
        for at in combinations(range(len(word)), 3):
            spanned = at[2] - at[0] + 1
            if spanned > tx.SPAN:
                continue
            norm += tx.DECAY ** (2 * spanned)
            codes = tuple(tx._code(word[i]) for i in at)
            if all(codes):
                found[codes] = found.get(codes, 0.0) + tx.DECAY**spanned
        return {k: v / norm**0.5 for k, v in found.items()}

    x, y = held(a), held(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items())


def test_table_of_weights_equals_the_kernel_machine():
    from laneweave.llm import toxicity as tx

    good, bad = ["idiot", "moron", "clown"], ["table", "house", "garden", "river", "motion"]
    scorer = tx._fit_words(good, bad)
    values = scorer.values([*good, *bad])
    assert (values[:3] > 0.5).all() and (values[3:] < -0.5).all()
    spoilt, far = scorer.values(["idi-ot", "umbrella"])
    assert spoilt > far  # a character put in stays nearer
    weights = [3.0, 1, 1, 1, 2, 1, 1, 5]
    landmarks, factors, offset = tx._machine(good, bad, weights)
    words = [*good, *bad, "idiiot", "m0ron", "rivers", "a-b", "zz"]
    plain = [offset + sum(f * plain_kernel(w, m) for f, m in zip(factors, landmarks, strict=True)) for w in words]
    assert np.allclose(tx._fit_words(good, bad, weights).values(words), plain, atol=1e-3)
    assert scorer.values([""])[0] == np.float32(scorer.offset)
    assert scorer.values(["x" * 500 + "idiot"])[0] > scorer.values(["x" * 500])[0]
    assert tx.text_words("so i d i o t ok") == ["so", "i", "d", "i", "o", "t", "ok", "idiot"]


def test_sentences_choose_their_words():
    from laneweave.llm import toxicity as tx

    value = {"idiot": 2.0, "river": 0.5, "table": 0.5, "house": -1.0}.__getitem__
    sentences = tx._sentences("River house. You? idiot, table! . House")
    assert sentences == [["house", "river"], ["idiot", "table", "you"], ["house"]]
    sentences = [[w for w in words if w != "you"] for words in sentences]
    assert tx._picked(sentences, 1, value) == {"idiot"}
    assert tx._picked(sentences, 0, value) == {"river", "idiot", "house"}
    assert tx._picked([["river", "table"]], 0, value) == {"table"}  # ties by the word
    assert tx._picked([], 1, value) == tx._picked([], 0, value) == set()
    assert tx._sentences(None) == tx._sentences(" . ") == tx._sentences("x" * 500) == []


def test_rules_learn_and_compile(spark):
    from laneweave.llm import quality_rules as qr

    rng = np.random.default_rng(9)
    x = rng.random((800, len(qr.NAMES)))
    y = ((x[:, 2] > 0.6) & (x[:, 5] < 0.5)).astype(float)
    model = qr.fit(x, y)
    assert 0 < len(model.rules) <= 2 * qr.MAX_RULES and ((model.scores(x) >= 0.5) == y).mean() > 0.97
    frame = spark.createDataFrame(pd.DataFrame(x, columns=list(qr.NAMES)).assign(i=range(800)))
    got = frame.select("i", model.expression({n: n for n in qr.NAMES}).alias("s")).toPandas().sort_values("i").s.to_numpy()
    assert np.allclose(got, model.scores(x))


def test_profiles_tell_languages():
    from laneweave.llm import language_id as li

    texts = {"a": "the house and the garden are green " * 5, "b": "der garten und das haus sind schön " * 5}
    profiles = {k: li.ranked(li.gram_codes(t), li.PROFILE_SIZE).tolist() for k, t in texts.items()}
    model = li.Identifier(profiles)
    assert model.best("the green house")[0] == "a" and model.best("das haus")[0] == "b"
    assert model.best(texts["a"]) == ("a", 1.0)
    assert model.best(None) == model.best("") == model.best("123 !") == ("und", 0.0)
    # the distance by definition
    own = li.ranked(li.gram_codes("the haus"), li.PROFILE_SIZE).tolist()
    away = sum(min(abs(profiles["a"].index(g) - i), li.PROFILE_SIZE) if g in profiles["a"] else li.PROFILE_SIZE for i, g in enumerate(own))
    assert model.distances(li.gram_codes("the haus"))[0] == pytest.approx(away / (len(own) * li.PROFILE_SIZE))


