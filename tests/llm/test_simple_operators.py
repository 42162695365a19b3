"""Language id, sharding, decontamination, PII, secrets, neighbours and quality against brute force, and on odd rows."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.llm import automata, decontaminate, langid, neighbours, pii, quality, queries, secrets, sharding

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------ 1: language id
def test_langid_held_out_accuracy(spark, documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = queries.op1_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_langid_odd_rows(odd, none):
    model = langid.fit(langid.training_rows(odd))
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (5, "und"), (9, "und")} <= got
    assert langid.identify(odd, model).count() == 10
    assert langid.identify(none, model).count() == 0
    nothing = langid.fit(langid.training_rows(none))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_langid_weights_are_sparse():
    model = langid.fit([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)
    assert model.nonzero < 0.01
    assert model.predict("the dog")[0] == "en" and model.predict("le chien")[0] == "fr"


def test_training_equals_brute_force():
    """FTRL-proximal with both penalties, coordinate by coordinate, and the calibrated temperature."""
    import math

    rows = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("кот и пёс", "ru"), ("a dog", "en"), ("un chien", "fr")] * 6
    alpha, beta, l1, l2, scale = 0.5, 1.0, 0.002, 0.0005, 20.0
    model = langid.fit(rows, epochs=2)
    langs = ["en", "fr", "ru"]
    feats = [(dict(zip(p.tolist(), tf.tolist(), strict=True)), langs.index(y)) for t, y in rows for p, tf in [langid._features(t)]]
    df = {}
    for f, _ in feats:
        for p in f:
            df[p] = df.get(p, 0) + 1
    idf = {p: math.log((1 + len(feats)) / (1 + c)) + 1 for p, c in df.items()}
    order = np.random.default_rng(7).permutation(len(feats)).tolist()
    z, n = {}, {}

    def weight(p, k):
        a, b = z.get((p, k), 0.0), n.get((p, k), 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(b)) / alpha + l2)

    def chances(x, t=1.0):
        s = [(weight("bias", k) + sum(v * weight(p, k) for p, v in x.items())) / t for k in range(3)]
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    for _ in range(2):
        for at, i in enumerate(order):
            if at % 5:
                f, y = feats[i]
                x = {p: tf * idf[p] * scale for p, tf in f.items()}
                err = [c - (k == y) for k, c in enumerate(chances(x))]
                new = {}
                for p, v in [*x.items(), ("bias", 1.0)]:
                    for k in range(3):
                        g, a, b = v * err[k], z.get((p, k), 0.0), n.get((p, k), 0.0)
                        new[p, k] = a + g - (math.sqrt(b + g * g) - math.sqrt(b)) / alpha * weight(p, k), b + g * g
                for key, (a, b) in new.items():
                    z[key], n[key] = a, b
    for p in df:
        assert np.allclose(model.weights[p], [weight(p, k) * idf[p] * scale for k in range(3)], rtol=1e-4, atol=1e-5)
    held = [feats[i] for i in order[::5]]
    loss = lambda t: -sum(math.log(chances({p: tf * idf[p] * scale for p, tf in f.items()}, t)[y] + 1e-12) for f, y in held) / len(held)
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121)).tolist()
    assert math.isclose(loss(model.temperature), min(map(loss, grid)), rel_tol=1e-6, abs_tol=1e-9)


def test_scripts_are_told_apart():
    """Letters of other scripts have codes of their own, so that languages outside a-z can be learned."""
    rows = [("кот и собака живут в доме", "ru"), ("γάτα και σκύλος στο σπίτι", "el"), ("חתול וכלב בבית", "he"), ("猫と犬が家にいます", "ja"), ("고양이와 개가 집에 있다", "ko")] * 12
    model = langid.fit(rows)
    for text, lang in (("собака и кот", "ru"), ("σκύλος και γάτα", "el"), ("כלב וחתול", "he"), ("犬と猫", "ja"), ("개와 고양이", "ko")):
        assert model.predict(text)[0] == lang
    far = "x" * ((1 << 20) - 1) + "собака"  # over the border of two pieces
    whole = langid._grams(far)
    assert whole.shape[1] == langid._grams(far[: 1 << 20]).shape[1] + langid._grams(far[(1 << 20) - 2 :], 2).shape[1]


def test_training_rows_are_bounded_by_rows(spark):
    """Many rows of one id neither crowd the driver nor vanish; the choice does not hang on partitions."""
    rows = [(1, f"same id {i}", "en") for i in range(3000)] + [(i, f"le chat {i}", "fr") for i in range(30)] + [(None, "no id", "de"), (5, None, "en"), (6, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_rows(df.repartition(5), rows_per_lang=100)
    assert got == langid.training_rows(df.repartition(2), rows_per_lang=100)
    assert [sum(y == x for _, y in got) for x in ("de", "en", "fr")] == [1, 100, 30]
    same = spark.createDataFrame([(1, "one row", "en")] * 500, df.schema)
    assert langid.training_rows(same, rows_per_lang=10) == [("one row", "en")] * 10
    labels = spark.createDataFrame([(1, 1), *[(i, i % 2) for i in range(2, 30)]], "doc_id long, quality int")
    some = quality.training_rows(df, labels, rows=20)
    assert some == quality.training_rows(df.repartition(7), labels, rows=20) and [sum(y == k for _, y in some) for k in (0, 1)] == [10, 10]


# ------------------------------------------------------------ 2: sharding
@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**64 - 1))
def test_feistel_is_a_permutation(n, key):
    f = sharding.Feistel(n, key)
    p = f.permute(np.arange(n))
    assert sorted(p.tolist()) == list(range(n))
    assert f.invert(p).tolist() == list(range(n))


def test_shards_follow_the_law(spark, documents):
    rows = queries.op2_sharding(spark, SF).collect()
    text = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    sizes = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.grown_shard is None for r in rows)
    order = sharding.Feistel(len(rows), 17).permute(np.array([r.row_no for r in rows]))
    assert order.tolist() == [r.slot * 8 + r.shard for r in rows]


def test_shards_do_not_depend_on_partitions(odd, none):
    a = sorted(map(tuple, sharding.shard_rows(odd).drop("row_no").collect()), key=str)
    b = sorted(map(tuple, sharding.shard_rows(odd.repartition(7)).drop("row_no").collect()), key=str)
    assert a == b and len(a) == 10
    assert sharding.shard_rows(none).count() == 0


# ------------------------------------------------------------ 3: decontamination
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_windows(text, items, window=10):
    ws = WORD.findall((text or "").translate(FOLD))
    hit, found = set(), set()
    for name, item in items:
        iw = WORD.findall((item or "").translate(FOLD))
        for k in range(max(1, len(iw) - window + 1) if iw else 0):
            w = iw[k : k + window]
            for i in range(len(ws) - len(w) + 1):
                if ws[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(name))
    return len(ws), len(hit), sorted(found)


def test_decontamination_query(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in queries.op3_decontamination(spark, SF).collect()}
    for d in documents.limit(60).collect():  # the brute-force side is slow
        n, hit, names = brute_windows(d.text, items)
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(names))
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest() and r.contaminated == (hit > 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 5))
def test_automaton_equals_brute_force(items, text, window):
    named = [(str(i), " ".join(x)) for i, x in enumerate(items)]
    auto = decontaminate.ItemAutomaton([(n, decontaminate.words_of(x.encode())) for n, x in named], window)
    spans, found = auto.scan([t.encode() for t in text])
    n, hit, names = brute_windows(" ".join(text), named, window)
    assert sum(b - a for a, b in spans) == hit and sorted({auto.items[i] for i in found}) == names


def test_blocks_of_items_give_the_same(spark, documents, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(str, decontaminate.digests(decontaminate.find_windows(documents, items)).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 500)
    assert sorted(map(str, decontaminate.digests(decontaminate.find_windows(documents, items)).collect())) == whole


def test_decontaminate_cuts_and_drops(spark, odd, none):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the LAZY dog and runs away"), (2, None), (3, "")], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(odd, items, max_coverage=0.9).collect()}
    assert out[1] == "The\nfrom the big red barn today" and out[2] is None and out[3] == "" and len(out[8]) > 100_000
    assert 1 not in {r.doc_id for r in decontaminate.decontaminate(odd, items, max_coverage=0.5).collect()}
    assert decontaminate.decontaminate(odd, items).columns == odd.columns
    assert decontaminate.decontaminate(none, items).count() == 0
    assert decontaminate.find_windows(odd, items.where("false")).where("_n_hit > 0").count() == 0


@pytest.mark.parametrize("block", [2_000_000, 3])
def test_cuts_that_make_windows_are_cut_again(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs = spark.createDataFrame([(1, "z a b a b c d c d y"), (2, "a x b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "b c")], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, max_coverage=1.0).collect()}
    assert out == {1: "z\ny", 2: "a x b"}
    nested = spark.createDataFrame([(1, "q a a b b r")], "doc_id long, text string")
    left = decontaminate.decontaminate(nested, items, max_coverage=1.0).first().text
    assert left == "q\nr"


@pytest.mark.parametrize("block", [2_000_000, 3])
def test_decontaminate_keeps_columns_of_any_name(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    items = spark.createDataFrame([(1, "a b"), (2, "c d")], "item_id long, text string")
    rows = [(1, "z a b y c d x", 4, "k", [1], 13, None), (2, None, None, None, None, None, 1), (3, "plain", 1, "", [], 5, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n_words int, _n_hit string, _spans array<int>, n_chars int, _items int")
    out = sorted(map(tuple, decontaminate.decontaminate(docs, items, max_coverage=0.9, chars_col="n_chars").collect()))
    assert out == [(1, "z\n y\nx", 4, "k", [1], 6, None), *rows[1:]]


# ------------------------------------------------------------ 4: PII
def brute_pii(text):
    out = []

    def luhn(n):
        d = [int(c) for c in n[::-1]]
        return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])

    for kind, pat in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pat, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(n) <= 19 and luhn(n) % 10 == 0, "phone": 9 <= len(n) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check_pii(rows, texts):
    for r in rows:
        want = brute_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in ("email", "ip", "card", "phone")]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_pii_query(spark, documents):
    check_pii(queries.op4_pii(spark, SF).collect(), {r.doc_id: r.text for r in documents.collect()})


def test_pii_on_made_up_texts(spark):
    rng = np.random.default_rng(5)
    bits = ["a", "b.c", "@", "x.org", ".", " ", "-", "+", "1", "4111", "1111", "378282246310005", "255", "300", "0", "+49", "(030)", "é", "_", "%", "\n", "00000000000000000000001"]
    rows = [(i, "".join(rng.choice(bits, rng.integers(0, 14)))) for i in range(3000)]
    check_pii(pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect(), dict(rows))


def test_pii_odd_rows_checksums_and_redaction(spark, odd, none):
    assert pii.pii_report(odd).count() == 10 and pii.pii_report(none).count() == 0
    out = {r.doc_id: r.text for r in pii.redact(odd).collect()}
    assert out[6] == "mail me: [EMAIL], card [CARD] or [IP] or [PHONE] é" and out[2] is None and out[3] == ""
    assert pii.redact(odd).columns == odd.columns
    more = spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32 end"), (2, "IBAN GB82 WEST 1234 5698 7654 33 end"), (3, "my ssn 123-45-6789"), (4, "part no 123-45-6789")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.pii_report(more).collect()}
    assert got[1] == "iban:5:32" and got[2] == "" and got[3].startswith("ssn:7:18") and got[4] == ""
    long = spark.createDataFrame([(1, "1" * 200_000 + "@"), (2, "1 " * 100_000), (3, "a." * 100_000 + "@"), (4, "1-" * 100_000 + "x"), (5, "AB12 " * 40_000)], "doc_id long, text string")
    begin = time.perf_counter()
    assert pii.pii_report(long).where("spans <> ''").count() == 0
    assert time.perf_counter() - begin < 30  # no pattern looks at a run again from each of its characters


def test_redaction_keeps_columns_of_any_name(spark):
    rows = [(1, "a@b.org and a@b.org", "x", [1], 3, 19), (2, "none", "y", [2], 4, 7), (3, None, "z", None, 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hit0 string, _spans array<int>, _redacted int, n_chars int")
    out = sorted(map(tuple, pii.redact(df, chars_col="n_chars").collect()))
    assert out == [(1, "[EMAIL] and [EMAIL]", "x", [1], 3, 19), (2, "none", "y", [2], 4, 7), (3, None, "z", None, 5, None)]


def test_pii_in_texts_full_of_it(spark):
    """Many matches in one text: places, overlaps and the time they take."""
    pieces = [f"u{i}@é{i % 7}.de 10.0.{i % 256}.1 x" for i in range(300)]
    text = "; ".join(pieces)
    row = pii.pii_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    check_pii([row], {1: text})
    mixed = "+49 30 1234567 4111 1111 1111 1111 a@1.2.3.4 b@1.2.3.4.c"
    docs = spark.createDataFrame([(1, mixed), (2, text)], "doc_id long, text string")
    spans = {r.doc_id: [s.split(":") for s in r.spans.split(",")] for r in pii.pii_report(docs).collect()}
    for r in pii.redact(docs).collect():
        source, out, at = {1: mixed, 2: text}[r.doc_id], [], 0
        order = [k.name for k in pii.BASE_KINDS + pii.MORE_KINDS]
        for start, _, end, kind in sorted((int(a), order.index(k), int(b), k) for k, a, b in spans[r.doc_id]):
            if start >= at:
                out += [source[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        assert r.text == "".join(out) + source[at:]
    many = spark.createDataFrame([(1, "mail a@b.org now " * 20_000)], "doc_id long, text string")
    for run in (lambda: pii.pii_report(many).first().n_email, lambda: pii.redact(many).first().text.count("[EMAIL]")):
        begin = time.perf_counter()
        assert run() == 20_000 and time.perf_counter() - begin < 30


# ------------------------------------------------------------ 5: secrets
BASE = [
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]
KINDS = ("assign", "access", "hex")


def brute_secrets(text):
    found = sorted((m.start(), r, m.end()) for r, (p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m))
    return [f"{KINDS[r]}:{a}:{b}" for a, r, b in found]


def check_secrets(rows, texts):
    for r in rows:
        want = brute_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in KINDS]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in KINDS] == want


def test_secrets_query(spark, documents):
    check_secrets(queries.op5_secrets(spark, SF).collect(), {r.doc_id: r.text for r in documents.collect()})


def test_secrets_on_made_up_texts(spark):
    rng = np.random.default_rng(6)
    bits = ["token", "passwd", "=", ":", " ", '"', "'", "api_key", "ApiKEY", "AKIA", "A0", "abcdef012345", "f", "0", "secret", "Zz-", ".", "ghp_", "é", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ſecret"]
    rows = [(i, "".join(rng.choice(bits, rng.integers(0, 16)))) for i in range(4000)]
    check_secrets(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect(), dict(rows))


def test_secrets_odd_rows(odd, none):
    check_secrets(secrets.find_secrets(odd).collect(), {r.doc_id: r.text for r in odd.collect()})
    assert secrets.find_secrets(odd).count() == 10 and secrets.find_secrets(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sampled_from(["a(b|c)*d", "(ab)+", "a{2,3}b?", "[^a]b", "(?i)ab|c{2}", "a.b"]), st.text("abcdAB\n", max_size=12))
def test_automaton_equals_re(pattern, text):
    dfa = automata.compile_rules([automata.Parser(pattern).parse()], anchored=True)
    s = dfa.start
    for b in text.encode():
        s = dfa.table[s * 256 + b]
    assert bool(dfa.accepts[s]) == bool(re.fullmatch(pattern, text))


# ------------------------------------------------------------ 8: neighbours
def brute_neighbours(rows, k=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in good:
        if q % 100 == 0:
            near = sorted((float(neighbours.distance(a, b[None])[0]), i) for i, b in good if i != q and len(b) == len(a))[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def test_neighbours_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in queries.op8_nearest(spark, SF).collect()) == brute_neighbours(rows)


def test_neighbours_ties_nulls_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(400)]
    rows += [(500, None), (600, [0.0] * 4), (601, [1.0, None, 1.0, 1.0]), (602, [float("nan")] * 4), (603, [float("inf"), 0.0, 0.0, 0.0]), (604, []), (700, [1e-30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    want = brute_neighbours(rows)
    ask = df.where("vec_id % 100 = 0")
    assert sorted(map(tuple, neighbours.search(df, ask).collect())) == want
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 150)
    assert sorted(map(tuple, neighbours.search(df, ask).collect())) == want
    assert neighbours.search(df.where("false"), ask.where("false")).count() == 0


# ------------------------------------------------------------ 10: quality
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op10_quality(spark, sf).collect()
    assert len(rows) == 1000
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for _, y, p in held) / len(held) > 0.9
    assert all((r.score >= 0.3) == bool(r.predicted) for r in rows)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 1), (6, 0), (7, 0), (7, 1), (9, None), (2, 1), (99, 1)], "doc_id long, quality int")
    model = quality.fit(quality.training_rows(odd, labels))
    out = quality.score(odd, model)
    assert out.count() == 10 and set(out.columns) == set(odd.columns)
    assert quality.score(none, model).count() == 0
    blank = quality.fit(quality.training_rows(none, labels))
    assert {r.score for r in quality.score(odd, blank).collect()} == {0.5}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_reads_tables_without_rows(spark, tmp_path, name):
    for t in ("documents", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    from tests.oracle import compare

    assert compare(spark, queries.queries()[name], queries.oracle_sql()[name], SF) is None


def test_votes_equal_brute_force(spark, documents):
    """TF-IDF, projection and vote of every document, term by term; ties to the labelled row that comes first."""
    import math

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.training_rows(documents, labels)
    model = quality.fit(rows + rows[:30])  # repeated rows tie
    base = [(v.tolist(), y) for v, y in zip(model.vectors, model.labels.tolist(), strict=True)]
    got = {r.doc_id: r.score for r in quality.score(documents, model).collect()}
    for d in documents.limit(40).collect():
        x = [math.log1p(c) * i for c, i in zip(quality.term_counts(d.text).tolist(), model.idf.tolist(), strict=True)]
        size = math.sqrt(sum(v * v for v in x))
        vec = [sum(v / size * a for v, a in zip(x, axis, strict=True) if v) for axis in model.axes.T.tolist()]
        size = math.sqrt(sum(v * v for v in vec))
        cos = sorted(((-round(sum(a * b for a, b in zip(v, vec, strict=True)) / size, 12), k) for k, (v, _) in enumerate(base)))[: quality.NEIGHBOURS]
        weights = [(max(-c, 0) ** quality.POWER, base[k][1]) for c, k in cos]
        want = (sum(w * y for w, y in weights) + 0.05 * model.prior) / (sum(w for w, _ in weights) + 0.05)
        assert abs(got[d.doc_id] - want) < 1e-9


def test_quality_axes_are_those_of_the_matrix(spark, documents):
    """The truncated SVD keeps about as much of the TF-IDF rows as the whole one of that rank."""
    rows = quality.training_rows(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    model = quality.fit(rows)
    x = np.log1p(np.array([quality.term_counts(t) for t, _ in rows])) * model.idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best = (np.linalg.svd(x, compute_uv=False)[: model.axes.shape[1]] ** 2).sum()
    assert ((x @ model.axes) ** 2).sum() > 0.99 * best


def test_quality_scores_do_not_hang_on_partitions(spark, documents):
    model = queries.quality_model(spark, documents, SF)
    scores = [{r.doc_id: r.score for r in quality.score(documents.repartition(n), model).collect()} for n in (1, 13)]
    assert scores[0] == scores[1]


def test_quality_hears_repetition(spark):
    """Words said over and over are no quality, in words that no labelled row has."""
    said = quality.term_counts("Vorp vorp is. " + "zzub " * 60)
    plain = quality.term_counts(" ".join(f"zub{i}" for i in range(60)))
    assert said[quality.HASHED :].sum() > 10 * quality.STEP_COUNT > plain[quality.HASHED :].sum()
