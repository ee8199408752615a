"""The methods themselves, against brute force on small inputs."""

import hashlib
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkdense.llm import (
    boosting,
    bpe,
    embedding_dedup,
    html_text,
    language_id,
    minhash,
    packing,
    pii,
    queries,
    repeats,
    toxicity,
)
from sparkdense.llm.boosting import BoostedTrees
from sparkdense.llm.queries import tokenizer_path

MULTI, PLAIN = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


@given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=60).map(str.encode)))
@settings(max_examples=300, deadline=None)
def test_suffix_array(text):
    assert repeats.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("classes", [64, 2])
def test_repeats_against_brute_force(spark, monkeypatch, classes):
    monkeypatch.setattr(repeats, "MAX_CLASSES", classes)
    random.seed(classes)
    words = ["".join(random.choices("abcdé", k=random.randint(1, 8))) for _ in range(300)]
    shared = " ".join(random.choices(words, k=40))
    texts = []
    for i in range(60):
        own = " ".join(random.choices(words, k=random.randint(0, 60)))
        cut = random.randint(0, len(shared) // 2)
        texts.append((i, own + (shared[cut:] if i % 3 else "") + own[: random.randint(0, 90)] + "x" * (i % 7) * 20))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    length = 40
    seen = Counter(t.encode()[s : s + length] for _, t in texts for s in range(len(t.encode()) - length + 1))
    found = {r["doc_id"]: r for r in repeats.remove_repeats(docs, length, 16).collect()}
    for i, text in texts:
        data = text.encode()
        covered = [any(seen[data[s : s + length]] > 1 for s in range(max(0, p - length + 1), p + 1) if s + length <= len(data)) for p in range(len(data))]
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        runs = sum(c and not covered[p - 1] if p else c for p, c in enumerate(covered))
        row = found[i]
        assert (row["n_removed"], row["n_spans"], row["kept_sha256"]) == (sum(covered), runs, hashlib.sha256(kept).hexdigest())


@given(st.text(max_size=200), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_tree_encoding(tree_pair, text, leaf):
    own, library = tree_pair
    own.leaf_chars = leaf
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert own.decode(own.encode(text), leaf=3) == text.encode()


@pytest.fixture(scope="module")
def tree_pair():
    import tiktoken

    path = tokenizer_path(MULTI)
    library = tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    return bpe.ByteBpe(path), library


def test_tree_encoding_of_mixed_text(tree_pair):
    own, library = tree_pair
    random.seed(3)
    parts = ["it's", " ", "  ", "\n", "\t ", "don't", "été", "x" * 50, "日本語", "123", "!?", " ", "'ll", " 9"]
    for leaf in (1, 2, 7, 64):
        own.leaf_chars = leaf
        for _ in range(150):
            text = "".join(random.choices(parts, k=random.randint(0, 40)))
            assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_packing_matches_the_tokenizer_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(PLAIN))
    library.encode_special_tokens = True
    random.seed(5)
    texts = [(i, " ".join(random.choices(["alpha", "béta", "<|endoftext|>", "x1", "\n"], k=random.randint(0, 90)))) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    packed = packing.pack_documents(docs, tokenizer_path(PLAIN), capacity=64, open_bins=8, with_ids=True)
    rows = packed.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in texts:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            part = struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]])
            assert (r["piece"], r["start"], r["ids_crc32"], bytes(r["ids"])) == (n, at, zlib.crc32(part), part)
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    whole = {r["sequence_id"]: bytes(r["input_ids"]) for r in packing.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == 4 * sum(r["length"] for r in rows)


@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 5))
def test_open_bins(sizes, limit):
    bins, free, opened = packing.OpenBins(20, limit), {}, []
    for size in sizes:
        number, offset = bins.place(size)
        fits = [b for b in opened if free[b] >= size]
        if fits:
            assert free[number] == min(free[b] for b in fits) and offset == 20 - free[number]
        else:
            assert offset == 0 and number not in free
            if size < 20 and len(opened) == limit:
                opened.remove(next(b for b in sorted(opened, key=lambda b: free[b]) if b not in bins.by_free[free[b]]))
            free[number] = 20
            opened.append(number)
        free[number] -= size
        if not free[number]:
            opened.remove(number)


def test_packing_leaves_little_free(spark):
    random.seed(8)
    lengths = [int(2048 * random.random() ** 3) + 1 for _ in range(6000)] + [2048] * 50
    items = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    rows = packing.best_fit(items, open_bins=256).collect()
    full = sum(lengths) / 2048
    assert len(rows) == len(lengths)
    assert full <= len({r["sequence_id"] for r in rows}) <= 1.005 * full + 1


def _links(texts, words, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    least = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            least[a] = min(least[a], least[b])
    return sets, least


@pytest.mark.parametrize("words", [2, 5])
def test_near_copies_against_brute_force(spark, words):
    random.seed(words)
    vocabulary = ["w%d" % i for i in range(200)]
    texts = []
    for g in range(12):
        base = random.choices(vocabulary, k=random.randint(1, 60))
        for _ in range(8):
            own = [random.choice(vocabulary) if random.random() < 0.03 else w for w in base]
            texts.append((len(texts) * 3 % 101, " ".join(own).upper() if g % 2 else "\t".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets, least = _links(texts, words, 80)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, words).collect()}
    assert found == {i: (len(sets[i]), least[i], least[i] == i) for i in sets}


def _edited_copies(number, seed):
    """Copies of one text, each with 0 to 6 words of its own; the least doc_id is too far from most others."""
    random.seed(seed)
    base = ["w%d" % i for i in range(100)]
    texts = []
    for i in range(number):
        own = list(base)
        for k in random.sample(range(100), 6 if i == 0 else i % 7):
            own[k] = f"own{i}x{k}"
        texts.append((i, " ".join(own)))
    return texts


@pytest.mark.parametrize("members", [16, 128])
def test_large_group_hands_on_links_only(spark, monkeypatch, members):
    texts = _edited_copies(210, 5)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    tested, confirmed = [], minhash._confirmed

    def spy(pairs, *rest):
        tested.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(minhash, "_confirmed", spy)
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", members)
    _, least = _links(texts, 2, 80)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 2).collect()}
    assert found == least
    assert sum(tested) < 210 * 209 / 8


def test_all_texts_of_a_doc_id_are_linked(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "something else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 2).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}


def test_estimate_from_low_bits():
    random.seed(8)
    both = [np.array(random.sample(range(1 << 40), 900), dtype=np.uint64) for _ in range(2)]
    shared = np.unique(np.concatenate([both[0], both[1][:100]]))
    a, b = (minhash.packed_low_bits(minhash.minima(x)).view(np.uint64) for x in (both[0], shared))
    equal = sum((int(x) >> s & 15) == (int(y) >> s & 15) for x, y in zip(a, b, strict=True) for s in range(0, 64, 4))
    estimate = (equal / minhash.MINIMA - 1 / 16) / (15 / 16)
    assert abs(estimate - 0.9) < 0.15


@pytest.mark.parametrize("cell", [5_000, 20])
def test_embeddings_against_brute_force(spark, cell):
    rng = np.random.default_rng(cell)
    centres = rng.normal(size=(30, 12))
    rows = [(i * 7 % 503, (centres[i % 30] + rng.normal(scale=rng.choice([0.02, 0.1, 0.5]), size=12)).astype(np.float32).tolist(), i % 2) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(vectors, 0.98, cell, 16).collect()}
    for label in (0, 1):
        own = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, k in rows if k == label]
        unit = np.array([v / np.linalg.norm(v) for _, v in own])
        linked = unit @ unit.T >= 0.98
        least = np.array([i for i, _ in own])
        for _ in own:
            least = np.where(linked, least[None, :], 1 << 60).min(axis=1)
        assert {i: found[i] for i, _ in own} == {i: (int(n) - 1, int(m)) for (i, _), n, m in zip(own, linked.sum(1), least, strict=True)}


NAIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@given(st.text("a.@-+ 1234567890()%é", max_size=60))
@settings(max_examples=500, deadline=None)
def test_plain_matches(text):
    expected = sorted((k, m.start(), m.end()) for k, p in NAIVE.items() for m in re.finditer(p, text))
    assert sorted(pii.plain_matches(text)) == expected


def test_checks_and_redaction():
    text = "mail a.b@c.org, 10.0.0.256 10.0.0.25, card 4111 1111 1111 1111 or 4111 1111 1111 1112, +49 (30) 1234-567."
    spans = pii.base_spans(text)
    assert [k for k, _, _ in spans] == ["email", "ip", "card", "phone"]
    assert pii.redacted(text, spans) == "mail [EMAIL], 10.0.0.256 [IP], card [CARD] or 4111 1111 1111 1112, [PHONE]."


def test_disguised_personal_data_is_added():
    rng = np.random.default_rng(0)
    trees = BoostedTrees().fit(np.array([pii.features(t, c) for t, c in _training(rng)]), np.array([float(c in pii.base_spans(t)) for t, c in _training(np.random.default_rng(0))]))
    model = pii.SpanModel(trees, {"card": 0.5, "ip": 0.5, "email": 2.0, "phone": 2.0})
    (added,) = model.added(["pay with card 4111/1111/1111/1111 now"])
    assert added == [("card", 14, 33)]
    assert model.added(["pay with card 4111/1111/1111/1112 now"]) == [[]]


def _training(rng):
    rows = []
    for _ in range(400):
        number = "".join(map(str, rng.integers(0, 10, 15)))
        digit = next(d for d in "0123456789" if pii.luhn(number + d))
        right = number + (digit if rng.random() < 0.5 else str((int(digit) + 1) % 10))
        text = f"pay with card {right[:4]} {right[4:8]} {right[8:12]} {right[12:]} now"
        rows += [(text, c) for c in pii.candidates(text)]
    return rows


def test_disguised_personal_data_is_learned(spark):
    rng = random.Random(3)
    words = "the list of all that was sent on time by them".split()
    kinds = [
        ("email", lambda n: f"ann{n} [at] host{n % 7} [dot] com"), ("email", lambda n: f"bob{n}(at)site.org"),
        ("ip", lambda n: f"10[.]{n % 200}[.]3[.]4"), ("phone", lambda n: f"0049/30/{1234567 + n}"),
        ("card", lambda n: "4111/1111/1111/1111"), (None, lambda n: f"300[.]{n % 200}[.]3[.]4"), (None, lambda n: "4111/1111/1111/1112"),
    ]
    texts, planted = [], {}
    for i in range(700):
        kind, make = kinds[i % 7]
        value, before = make(i), " ".join(rng.choices(words, k=6)) + " "
        texts.append((i, f"{before}{value} {' '.join(rng.choices(words, k=6))}"))
        planted[i] = f"{kind}:{len(before)}:{len(before) + len(value)}" if kind else ""
    # a plain span for every disguised one, then almost none
    for plain in (700, 3):
        own = [(1000 + i, f"mail x{i}@y{i}.com or {i % 250}.1.2.3 now") for i in range(plain)]
        docs = spark.createDataFrame(texts + own, "doc_id long, text string")
        found = {r["doc_id"]: r["spans"] for r in pii.detect(docs, pii.learn(docs)).where("doc_id < 1000").collect()}
        assert found == planted


def test_few_disguised_spans_are_found(spark):
    rows = [(i, f"row {i} of {i * 37 % 911} items, made {i % 28 + 1}.{i % 12 + 1}.2020 at 10:{i % 50 + 10}") for i in range(400)]
    rows += [(900, "please write to ann [at] host [dot] com today"), (901, "call 0049-30-1234567 today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.detect(docs, pii.learn(docs)).where("spans != ''").collect()}
    assert found == {900: "email:16:39", 901: "phone:5:20"}


def test_boosted_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = BoostedTrees().fit(x[:1000], y[:1000])
    assert ((trees.predict(x[1000:]) > 0.5) == (y[1000:] == 1)).mean() > 0.95


@pytest.mark.parametrize("few", [boosting.FEW_ROWS, 0])
def test_boosted_trees_of_a_table_are_those_of_its_rows(spark, monkeypatch, few):
    monkeypatch.setattr(boosting, "FEW_ROWS", few)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 60, size=(3000, 3)) / 7.0
    y = ((x[:, 0] > 3) ^ (x[:, 1] > 5)).astype(float)
    local = BoostedTrees(rounds=4).fit(x, y)
    rows = spark.createDataFrame([(r.tolist(), 1) for r in x], "row array<double>, n long").repartition(3)
    spread = BoostedTrees(rounds=4).fit_cuts(rows, 3)
    assert all(np.allclose(a, b) for a, b in zip(spread.cuts, local.cuts, strict=True))
    counts = Counter(zip(spread.packed(x), y.tolist(), strict=True))
    counted = spark.createDataFrame([(bytearray(b), v, n) for (b, v), n in counts.items()], "bins binary, y double, n long")
    spread.fit_counted(counted.repartition(3))
    for mine, theirs in zip(spread.trees, local.trees, strict=True):
        assert all(np.allclose(a, b) for a, b in zip(mine, theirs, strict=True))


def test_spans_are_learned_from_all_documents(spark, monkeypatch):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("v 300."), "id", F.lit(".3.4")).alias("text"))
    seen = []

    def watched(self, counted):
        held = counted.sparkSession.read.parquet(os.path.dirname(counted.inputFiles()[0]))
        seen.append(held.where("natural = 1").agg(F.sum("n")).first()[0])
        return self

    monkeypatch.setattr(BoostedTrees, "fit_counted", watched)
    monkeypatch.setattr(BoostedTrees, "predict_packed", lambda self, bins: np.zeros(len(bins)))
    pii.learn(docs.unionByName(docs))
    made_up = sum(row[-2] for seed in (0, 1) for text in pii._made_up(seed) for row in pii.examples(text))
    assert seen == [sum(row[-2] for i in range(30_000) for row in pii.examples(f"v 300.{i}.3.4")) + made_up]


@pytest.fixture(scope="module")
def letters_model():
    counts = np.zeros(toxicity.SYMBOLS**3)
    for word in ["idiot", "moron", "pathetic", "the", "and", "loser", "all", "well", "is"] * 50:
        ids = [0, 0, *[toxicity.LETTERS.index(c) + 1 for c in word], 0]
        for a, b, c in zip(ids, ids[1:], ids[2:], strict=False):
            counts[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += 1
    return toxicity.log_probabilities(counts.reshape((toxicity.SYMBOLS,) * 3))


@pytest.mark.parametrize("token", ["1d10t", "idi0t", "i.d.i.o.t", "idiooot", "!diot", "iiiidiot", "id!ot!!"])
def test_restored_words(letters_model, token):
    assert toxicity.Restorer(letters_model)[token] == "idiot"


def test_restored_text(letters_model):
    restorer = toxicity.Restorer(letters_model)
    assert toxicity.restored("The m o r o n, and the p@th3tic l0ser!", restorer) == "the moron and the pathetic loser"
    assert toxicity.Restorer(letters_model)["well"] == "well"


@pytest.fixture(scope="module")
def sentence_model():
    """The character model of running text, so that it knows how words follow each other."""
    text = "you are such a stupid man and all of the men are as well as you. what a fool you are. the idiot is here. " * 30
    ids = [0, 0, *[int(toxicity._SYMBOL[ord(c)]) for c in text], 0]
    counts = np.zeros((toxicity.SYMBOLS,) * 3)
    for a, b, c in zip(ids, ids[1:], ids[2:], strict=False):
        counts[a, b, c] += 1
    return toxicity.log_probabilities(counts)


def test_spaced_text_is_cut_into_words(sentence_model):
    restorer = toxicity.Restorer(sentence_model)
    assert toxicity.restored("such a s t u p i d man", restorer) == "such a stupid man"
    assert toxicity.restored("y o u i d i o t", restorer) == "you idiot"
    sentence = "you are such a stupid man and all of the men are as well as you"
    assert restorer[" ".join(sentence.replace(" ", ""))] == sentence
    assert restorer[" ".join(sentence.replace(" ", "") * 40)].split() == sentence.split() * 40
    assert restorer["s t u u u u p 1 d"] == "stupid"


def test_long_tokens_are_decoded(sentence_model):
    restorer = toxicity.Restorer(sentence_model)
    assert restorer["st" + "u" * 5_000 + "p1d"] == "stupid" == restorer["s" + "." * 200_000 + "tup1d"]
    score = toxicity.ToxicityModel(sentence_model, {"stupid": 5.0}, (-4.0, 2.0, 0.0)).scorer()
    plain = "you are such a stupid man and all of the men are as well as you"
    assert score(plain) == score(" ".join(plain.replace(" ", ""))) == score("you stu" + "u" * 90 + "pid man") > 0.9 > score("you are")


def test_toxicity_on_held_out_documents(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    found = queries.op4_noisy_channel(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in found) / len(found)
    assert right > 0.93


def test_language_on_held_out_documents(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    found = queries.op1_language_id(spark, sf).join(queries.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) / len(found) > 0.97
    assert sum(r["rejected"] for r in found) / len(found) < 0.02


def test_mixtures_and_unlearned_languages_are_rejected(spark, sf_dir):
    docs = queries.table(spark, sf_dir.replace("0.001", "0.01"), "documents").where("lang IS NOT NULL AND length(text) > 300")
    taught = docs.where("doc_id % 2 = 1").select("doc_id", "text", "lang")
    others = [r for r in docs.where("doc_id % 2 = 0").select("text", "lang").orderBy("doc_id").collect()]
    mixed, last = [], None
    for row in others:
        if last is not None and last["lang"] != row["lang"]:
            half = min(len(last["text"]), len(row["text"])) // 2
            mixed.append((last["text"][:half] + " " + row["text"][:half],))
        last = row
    found = language_id.identify(spark.createDataFrame(mixed, "text string"), language_id.learn_dictionaries(taught)).collect()
    assert len(found) > 50 and sum(r["rejected"] for r in found) / len(found) > 0.85
    french = spark.createDataFrame([(r["text"],) for r in others if r["lang"] == "fr"], "text string")
    found = language_id.identify(french, language_id.learn_dictionaries(taught.where("lang <> 'fr'"))).collect()
    assert len(found) > 20 and sum(r["rejected"] for r in found) / len(found) > 0.85


def test_language_coder_is_reused():
    coder = language_id._coder(b"the quick brown fox " * 50, *language_id.CODERS[0])
    assert len(coder.compress(b"the quick brown fox")) < len(coder.compress(b"zxqj wvk plm ghtd"))


def test_host_consensus_beats_a_page_of_its_own(spark):
    usual = "<body><div class='story9'><p>{0} real words of the story</p></div><div class='extra'><p>short</p></div></body>"
    odd = "<body><div class='story4'><p>tiny</p></div><div class='extra'><p>{0}</p></div></body>".format("long filler text " * 20)
    rows = [(i, "http://h/%d" % i, usual.format("many " * 20)) for i in range(5)] + [(9, "HTTP://H/x", odd)]
    found = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[9] == "tiny" and found[0].endswith("real words of the story")
