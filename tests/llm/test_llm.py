import hashlib
import random
import unicodedata
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitweave.llm import bpe, chat, exact_dedup, fingerprints, language_id, mixing, quality, simhash, suffix_dedup, toxicity
from hitweave.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "é", "a b", "a  b", "A\tb", "word " * 4000, "x" * 30_000, "!!! 123", "a b", "ﬁn É", "fin é"]


def docs(spark, texts, extra=False):
    rows = spark.createDataFrame([(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)
    clash = {c: F.lit("clash") for c in ("_id", "_norm", "_range", "fp", "h", "block", "score", "label", "component_id", "keep_id", "slot")}
    return rows.withColumns(clash) if extra else rows


def sentences(seed, n, words):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) for _ in range(n)]


EN, DE = "the of and house water stone with from over".split(), "der und das haus wasser stein mit von über".split()


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD, extra=True)


# --- language -----------------------------------------------------------------------------------

def test_codewords_keep_apart():
    for n in (2, 4, 5, 9):
        code = language_id.codewords(n)
        gaps = (code.shape[1] - code @ code.T) / 2
        assert (gaps + np.eye(n) * 99).min() >= max(1, code.shape[1] // 5)


def test_language(spark, odd):
    texts = sentences(1, 60, EN) + sentences(2, 60, DE)
    model = language_id.train(texts, ["en"] * 60 + ["de"] * 60)
    rows = docs(spark, [sentences(9, 1, EN)[0], sentences(8, 1, DE)[0], None, "12 !"])
    found = [(r.lang_pred, r.ambiguous) for r in language_id.identify(rows, model).orderBy("doc_id").collect()]
    assert found == [("en", False), ("de", False), ("und", True), ("und", True)]
    assert language_id.identify(odd, model).count() == len(ODD)
    assert language_id.fit(docs(spark, [])) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


# --- toxicity and quality -----------------------------------------------------------------------

def test_gradients_are_right():
    rng = np.random.default_rng(0)
    features = toxicity.Features(["", "alpha", "beta", "gamma", "delta"])
    net = toxicity.Network.fresh(np.zeros(toxicity.WORDS, np.float32), np.zeros(toxicity.GRAMS, np.float32), rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, target = rng.integers(0, 5, (6, toxicity.WINDOW)), np.array([0, 1, 1, 0, 1, 0.0])
    rows[:, 0] = 1

    def loss():
        x = features.vectors(net.p, np.arange(5))
        table = np.concatenate([x @ net.p["wf"] + net.p["cf"], x @ net.p["wb"] + net.p["cb"]], axis=1)
        z = net.window_logits([table[rows[:, t]] for t in range(toxicity.WINDOW)], rows > 0)
        return float(np.mean(np.logaddexp(0, z) - target * z))

    grads = toxicity.gradients(net, rows, target, features)
    for name in ("wf", "uf", "ub", "attend", "out", "bias", "cb"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        was, step = net.p[name][at], 1e-2
        net.p[name][at] = was + step
        up = loss()
        net.p[name][at] = was - step
        down = loss()
        net.p[name][at] = was
        assert abs((up - down) / (2 * step) - grads[name][at]) < 0.05 * abs(grads[name][at]) + 1e-4, name


def test_toxicity(spark, odd):
    words = EN + [f"w{i * i}" for i in range(300)]
    clean, bad = sentences(1, 120, words), [t.replace("house", "scumbag") + " scumbag of" for t in sentences(2, 60, words)]
    model = toxicity.train(clean + bad, [0] * 120 + [1] * 60, steps=300)
    fresh = docs(spark, sentences(5, 20, words) + [t + " scumbag" for t in sentences(6, 20, words)])
    found = [r.predicted for r in toxicity.score_toxicity(fresh, model).orderBy("doc_id").collect()]
    assert sum(found[:20]) <= 1 and sum(found[20:]) >= 19
    scores = toxicity.score_toxicity(odd, model, ["doc_id"]).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.train(["a"], [0]) is None
    assert {r.score for r in toxicity.score_toxicity(odd, None).collect()} == {0.0}


def test_long_words_are_read_to_their_end():
    for n in (62, 63, 93, 94, 124, 1000):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        found = toxicity.tokens(f"a {word} b")
        assert found[0] == "a" and found[-1] == "b" and max(map(len, found)) <= 62
        assert all(any(word[i : i + 4] in piece for piece in found[1:-1]) for i in range(n - 3))
    words = EN + [f"w{i * i}" for i in range(300)]
    clean, bad = sentences(1, 120, words), [t.replace("house", "scumbag") + " scumbag of" for t in sentences(2, 60, words)]
    reader = toxicity.Reader(toxicity.Network({k: v for k, v in toxicity.train(clean + bad, [0] * 120 + [1] * 60, steps=300).items() if k != "curve"}))
    mild, foul = reader.logits(["of-the_" * 40 + "house", "of-the_" * 40 + "scumbag"])
    assert foul > mild


def test_windows_cover_every_word():
    class Echo:
        def projections(self, words):
            return np.array([[float(w[1:])] * (6 * toxicity.HIDDEN) for w in words], np.float32)

        def window_logits(self, steps, real):
            return np.max([np.where(real[:, t], s[:, 0], 0) for t, s in enumerate(steps)], axis=0)

    for n in (1, 7, 8, 16, 17, 24, 25, 100):
        for top in (0, n // 2, n - 1):
            text = " ".join(f"w{1000 if i == top else i}" for i in range(n))
            assert toxicity.Reader(Echo()).logits([text, None])[0] == 1000


def test_quality(spark, odd):
    good, bad = sentences(1, 150, EN), [" ".join(w.upper() + "!!" for w in t.split()) for t in sentences(2, 150, EN)]
    model = quality.train(good + bad, [1] * 150 + [0] * 150)
    fresh = docs(spark, sentences(5, 30, EN) + [" ".join(w.upper() + "!!" for w in t.split()) for t in sentences(6, 30, EN)])
    found = [r.predicted for r in quality.score_quality(fresh, model).orderBy("doc_id").collect()]
    assert sum(found[:30]) >= 29 and sum(found[30:]) <= 1
    scores = quality.score_quality(odd, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert quality.train(["a"], [1]) is None


# --- tokens -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    return bpe.ByteBpe(bpe.read_ranks(bpe.public_vocabulary()[0]))


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(777)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(777)) and table.slots(keys).tolist() == list(range(777))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_tiktoken(model, text):
    import tiktoken

    pattern = bpe.public_vocabulary()[1]
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=model.ranks, special_tokens={})
    ids = bpe.Encoder(model, pattern).encode([text])[0]
    assert ids.tolist() == other.encode_ordinary(text)
    assert model.decode(ids) == text.encode()


def test_token_rows(spark, odd):
    path, pattern = bpe.public_vocabulary()
    found = {r.doc_id: r for r in bpe.token_digests(odd, path, pattern).collect()}
    assert len(found) == len(ODD)
    assert all(r.decoded_sha256 == hashlib.sha256((ODD[i] or "").encode()).hexdigest() for i, r in found.items())
    assert found[0].n_tokens == 0 and found[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    again = odd.withColumn("ids", bpe.encode(F.col("text"), bpe.ByteBpe(bpe.read_ranks(path)), pattern))
    assert again.filter("size(ids) > 0").count() == len(ODD) - 2


def test_forgetting_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder = bpe.Encoder(model, bpe.public_vocabulary()[1])
    texts = sentences(3, 20, EN)
    assert [encoder.encode([t])[0].tolist() for t in texts] == [bpe.Encoder(model, bpe.public_vocabulary()[1]).encode([t])[0].tolist() for t in texts]


# --- exact copies -------------------------------------------------------------------------------

def test_exact_dedup(spark, odd):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in ODD]
    for found in (exact_dedup.exact_dedup(odd), exact_dedup.exact_dedup_by_content(odd)):
        rows = {r.doc_id: r for r in found.collect()}
        assert all(rows[i].keep_id == norm.index(t) and rows[i].group_size == norm.count(t) and rows[i].kept == (norm.index(t) == i) for i, t in enumerate(norm))
    kept = exact_dedup.keep_first(odd.union(odd))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({norm.index(t) for t in norm}) and kept.columns == odd.columns
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    nulls = docs(spark, ["a", "a"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r.keep_id, r.kept, r.group_size) for r in exact_dedup.exact_dedup(nulls).collect()] == [(None, True, 2)] * 2
    hot = docs(spark, ["same"] * 3000 + [f"t{i}" for i in range(100)])
    assert exact_dedup.exact_dedup(hot).filter("kept").count() == 101


def canon(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "").lower()).strip()


def test_fingerprints(spark, odd, tmp_path):
    found = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_documents(odd).select("doc_id", "fingerprint").collect()}
    for i, a in enumerate(ODD):
        for j, b in enumerate(ODD):
            assert (found[i] == found[j]) == (canon(a) == canon(b))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in fingerprints.op4_fingerprints(spark, str(tmp_path)).collect()}
    for i, t in enumerate(ODD):
        text, other = t or "", ODD[i - 1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(text)
        assert rows[i].near_edited == float(canon(edited) == canon(text)) and rows[i].near_next == float(canon(other) == canon(text))
        assert (rows[i].edited_fingerprint == rows[i].fingerprint) == (rows[i].near_edited == 1)
        assert rows[i].fingerprint == found[i]


def test_clashing_digests_are_told_apart(spark):
    texts = spark.createDataFrame([("one",), ("two",), ("one",)], "text string")
    d = F.struct(F.lit(1).cast("long").alias("d1"), F.lit(2).cast("long").alias("d2"), F.unhex(F.sha2("text", 256)).alias("sha"))
    rows = texts.select(d.alias("d"), "text")
    found = fingerprints.clashes(rows, fingerprints.shared_digests(rows)).collect()
    assert sorted(r.number for r in found) == [0, 1]


def test_next_row_crosses_ranges(spark):
    ids = [5, 1, 900, 17, 18, 44, 1000, 3, None]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    order = [1000, 900, 44, 18, 17, 5, 3, 1, None]
    for size in (1, 2, 100):
        found = {r.doc_id: r._next.doc_id for r in fingerprints.with_next(rows, "doc_id", "text", size).collect()}
        assert found == {a: order[(k + 1) % len(order)] for k, a in enumerate(order)}


# --- near copies --------------------------------------------------------------------------------

def brute_simhash(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=2):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_rows(spark, odd):
    values = [brute_simhash(t) for t in ODD]
    assert [simhash.simhash(t) for t in ODD] == values
    rows = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert [rows[i].component_id for i in range(len(ODD))] == brute_components(values)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    kept = simhash.keep_representatives(odd)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(values))) and kept.columns == odd.columns


@pytest.mark.parametrize("tile", [4, 64])
def test_links_span_all_close_pairs(spark, tile):
    rng = random.Random(tile)
    values = [0, 1]
    for _ in range(250):
        base = rng.choice(values)
        for _ in range(rng.randrange(1, 4)):
            base ^= 1 << rng.randrange(64)
        values.append(base)
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, tile)
    found = {r.node: r.root for r in connected_components(edges).collect()}
    groups = brute_components(values)
    label = [found.get(v, v) for v in signed]
    assert len(set(zip(groups, label))) == len(set(groups)) == len(set(label))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201), (300, 300)], "a long, b long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(61)} | {200: 200, 201: 200}


def five_word_sets(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


@pytest.mark.parametrize("tile", [3, 256])
def test_similar_shingles_are_near_copies(spark, monkeypatch, tile):
    from hitweave.llm import near_copies

    monkeypatch.setattr(near_copies.similar_links, "__defaults__", (tile,))
    rng = random.Random(8)
    texts = [None, "", "a b", "A  b", "a b c"]
    for base in sentences(3, 8, [f"w{i}" for i in range(500)]):
        words = (base.split() * 60)[:60] if len(base.split()) > 40 else [f"{base[:4]}{i}" for i in range(60)]
        for _ in range(8):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(60)] = f"n{rng.randrange(999)}"
    sets, values = five_word_sets(texts), [brute_simhash(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if bin(values[i] ^ values[j]).count("1") <= 2 or (union and len(sets[i] & sets[j]) >= 0.8 * union):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, texts), similar=(5, 0.8)).collect()}
    assert [found[i] for i in range(len(texts))] == root
    assert root != brute_components(values)


# --- repeated passages --------------------------------------------------------------------------

def brute_passages(rows, length=50):
    first: dict[bytes, int] = {}
    for i, t in sorted(rows, reverse=True):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = i
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        out[i] = (bytes(x for x, g in zip(b, gone) if not g), len(re.findall(b"\1+", bytes(gone))))
    return out


@pytest.mark.parametrize("block,part", [(1 << 20, 1 << 20), (300, 200)])
def test_passages(spark, block, part):
    rng = random.Random(3)
    base = sentences(4, 12, EN + DE)
    texts = [*ODD[:7], "ab" * 100, "ab" * 90]
    for _ in range(40):
        texts.append(" ".join(rng.sample(base, 2))[rng.randrange(20) :] + rng.choice(["", " tail", "ü"]))
    rows = list(enumerate(texts))
    found = {r.doc_id: (bytes(r.kept), len(r.span_starts)) for r in suffix_dedup.remove_repeats(docs(spark, texts, True), block_bytes=block, range_bytes=part).collect()}
    assert found == brute_passages(rows)
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_passages_with_equal_and_null_ids(spark):
    text = sentences(6, 1, EN * 3)[0] * 3
    rows = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    found = sorted((r.doc_id is None, len(r.kept)) for r in suffix_dedup.remove_repeats(rows).collect())
    assert found == [(False, len(text)), (False, len(text)), (True, 0)]


def test_a_trigger_in_every_document(spark):
    """A line in ever new surroundings: its triggers are hot, and its passages meet by their own hashes."""
    rng = random.Random(5)
    line, texts = "the quick brown fox jumps over the lazy dog and runs on", []
    for i in range(60):
        around = "".join(rng.choice("abcdefgh ") for _ in range(120))
        texts.append(around[:60] + line + around[60:] if i % 5 else texts[-1] if texts else line)
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[3]), (7, "another " + line), (None, texts[4]), (None, texts[4])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, t in sorted(((10**9 if i is None else i), t) for i, t in rows)[::-1]:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = i
    expected = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < (10**9 if i is None else i):
                gone[p : p + 50] = b"\1" * 50
        expected.append((i is None, i or 0, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), "".join(c for c, g in zip(t, gone) if not g)))
    for hot, many, block, part in ((2, 2, 700, 400), (1 << 12, 8, 700, 400), (0, 1, 1 << 20, 1 << 20)):
        found = suffix_dedup.remove_repeats(frame, block_bytes=block, range_bytes=part, hot_phrases=hot, many=many).collect()
        made = [(r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_bytes - len(r.kept), len(r.span_starts), bytes(r.kept).decode()) for r in found]
        assert sorted(made) == sorted(expected), (hot, many)


def test_strides_change_nothing(spark, monkeypatch):
    import pandas as pd

    text = " ".join(sentences(7, 30, EN))
    whole = suffix_dedup.Block(pd.DataFrame({"doc_id": [1], "text": [text]}), 50)
    monkeypatch.setattr(suffix_dedup, "STRIDE", 64)
    cut = suffix_dedup.Block(pd.DataFrame({"doc_id": [1], "text": [text]}), 50)
    assert set(whole.hashes) == set(cut.hashes) and (cut.last - cut.first + 1).sum() == (whole.last - whole.first + 1).sum()


# --- mixing and chat ----------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), st.integers(1, 30), min_size=1, max_size=6))
def test_every_source_stays_within_a_block(weights):
    total, done = sum(weights.values()), dict.fromkeys(weights, 0)
    for t, (name, k) in enumerate(mixing.period(weights), 1):
        assert k == done[name] and k * total // weights[name] <= t - 1 and t <= -(-(k + 1) * total // weights[name])
        done[name] += 1
        assert all(abs(done[s] * total - weights[s] * t) < total for s in weights)
    assert done == weights


def test_mixing_places_every_row(spark, odd):
    placed = mixing.mix(odd, {"src1": 3}, block=2)
    rows = placed.collect()
    assert len(rows) == len(ODD) and len({r.place for r in rows}) == len(ODD)
    assert mixing.mix(docs(spark, []), {}).count() == 0
    out = mixing.interleave(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)


TALK = "conv_id long, turn long, role string, text string"


def test_quotes_are_linked(spark):
    rows = spark.createDataFrame([
        (1, 0, "user", "How tall is it?\nAnd how old?"), (1, 1, "assistant", "On Monday you wrote:\n> How tall is it?\n\nTen metres."),
        (1, 2, "user", "> > how   TALL is it?\n> Ten metres.\nThanks."), (1, 3, "assistant", "> And how old?\nVery."), (2, 0, "user", "> Ten metres.\nReally?"),
        (None, None, None, None), (3, 0, "user", ""), (3, 0, "user", ""),
    ], TALK)
    found = chat.conversations(rows.withColumn("position", F.lit("clash"))).orderBy("conv_id", "position").collect()
    ids = {(r.conv_id, r.turn): r.message_id for r in found}
    by = {(r.conv_id, r.turn): (r.content, r.link, r.parent_id) for r in found}
    assert by[1, 1] == ("Ten metres.", "quote", ids[1, 0])
    assert by[1, 2] == ("Thanks.", "quote", ids[1, 1])
    assert by[1, 3] == ("Very.", "quote", ids[1, 0])
    assert by[2, 0] == ("Really?", "quote", ids[1, 1])
    assert by[None, None] == ("", "root", None) and len(found) == 8
    assert [r.position for r in found if r.conv_id == 1] == [0, 1, 2, 3]
    assert chat.conversations(rows.limit(0)).count() == 0


def test_partial_quotes_of_many_lines_are_linked(spark):
    rng = random.Random(12)
    rows, expected = [], {}
    for c in range(12):
        own = [[f"c{c} m{m} line{k} {rng.randrange(99)}" for k in range(6)] for m in range(3)]
        own[1][2] = own[0][2]  # a line that an earlier message has too
        for m, ls in enumerate(own):
            rows.append((c, m, "user", "\n".join(ls[:3]) + "\n\n" + "\n".join(ls[3:])))
        m = rng.randrange(2)
        a = rng.randrange(5)
        b = rng.randrange(a + 2, 7)
        quotes = [own[m][a:b], [" ".join(own[m][3:])], [own[m][0], "[...]", own[m][4]], [own[0][0], own[1][1]]]
        kind = c % 4
        rows.append((c, 3, "user", "\n".join("> " + s for s in quotes[kind]) + "\nreply"))
        text = " ".join(quotes[0])
        expected[c] = next(i for i in range(3) if text in " ".join(own[i])) if kind == 0 else m if kind < 3 else None
    found = chat.conversations(spark.createDataFrame(rows, TALK)).collect()
    ids = {(r.conv_id, r.turn): r.message_id for r in found}
    for r in found:
        if r.turn == 3:
            m = expected[r.conv_id]
            assert (r.link, r.parent_id) == (("order", ids[r.conv_id, 2]) if m is None else ("quote", ids[r.conv_id, m])), r.conv_id
    assert {m for m in expected.values() if m is not None} == {0, 1}


def test_long_conversations_are_ranked_in_ranges(spark):
    rows = spark.range(0, 700).select(F.lit(1).cast("long").alias("conv_id"), (F.col("id") * 3).alias("turn"), F.lit("user").alias("role"), F.format_string("m%d", "id").alias("text"))
    found = chat.conversations(rows).orderBy("turn").collect()
    assert [r.position for r in found] == list(range(700)) and all(b.parent_id == a.message_id for a, b in zip(found, found[1:]))


# --- pipeline -----------------------------------------------------------------------------------

def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [*sentences(1, 12, EN), None, "12 34", sentences(1, 1, EN)[0], sentences(1, 1, EN)[0].replace(" ", "  "), *sentences(2, 6, DE)]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    norm = {}
    for i, t in enumerate(texts):
        if t and any(map(str.isalpha, t)):
            norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    kept = sorted(norm.values())
    groups = brute_components([brute_simhash(texts[i]) for i in kept])
    expected = {kept[g] for g in groups}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == expected and len(rows) == len(expected)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
