"""The operators against brute force on small tables that hold every odd case."""

import collections
import hashlib
import itertools
import re
import zlib

import brute as slow
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann, catalogue, fingerprints, licenses, mixing, neardup, packing, pii, quality, secret_scan, tokenizing, toxicity
from marlstone.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _text string, sig int, _shift double, size int"
WORDS = "the quick brown fox jumps over a lazy dog while seven bright birds sing near old river stones and nobody minds at all".split()


def prose(n: int, seed: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(r.integers(0, len(WORDS), n), r.integers(0, 50, n), strict=True))


BASE = prose(120, 1)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
TEXTS = [
    None, "", "  ", "one two three", BASE, BASE, NEAR, prose(300, 2), prose(9000, 3), "é日本 ñ " + prose(40, 4), "password: token: abcdefgh AKIA" + "Z9" * 9,
    "mail a.b@c.org or 10.0.0.256 and 1.2.3.4, +1 (499) 555-6503, 4785 3805 9239 1139", "Released under the MIT License.\n" + prose(30, 5), "!!! ???", "!!! ???", "x" * 70_000,
]


def rows():
    return [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"src{i % 4}", len(t or ""), "k", "t", 1, 0.5, 3) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    more = [(3, "one two three", "en", "src3", 13, "k", "t", 1, 0.5, 3), (None, BASE, None, None, None, None, None, None, None, None), (None, "alone here", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows() + more, SCHEMA).cache()


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(len(TEXTS))] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


# Packing


def test_tokens_are_the_librarys():
    t = tokenizing.Tokenizer(catalogue.tokenizer_path())
    odd = ["", "a\x1cb c", "<|endoftext|>x <|startoftext|>", "Σας ΟΔΟΣ ſ Kelvin", "é ́x", "a b c\x85d", "it's 12's ''s I'LL", "x" * 5000, "İI ı ŉ ß ẞ", "aaaaaaa bbbb aaa", "日本語 テキスト", "­ soft­hyphen"]
    for text, ids in zip(odd + [prose(500, 7)], t.encode(odd + [prose(500, 7)]), strict=True):
        assert ids.tolist() == t.library.encode(text, add_special_tokens=False).ids
    small = tokenizing.Tokenizer(catalogue.tokenizer_path(), cache_bytes=8_000)
    for k in range(5):
        assert small.encode([prose(100, k)])[0].tolist() == t.library.encode(prose(100, k), add_special_tokens=False).ids


def test_long_texts_are_cut_at_space_only():
    text = " ".join(["word"] * 1000)
    assert "".join(tokenizing.slices(text, 100)) == text
    assert all(p == "" or p[0] == " " or p.startswith("word") for p in tokenizing.slices(text, 100))
    assert list(tokenizing.slices("x" * 500, 100)) == ["x" * 500]


@pytest.mark.parametrize("options", [{}, {"capacity": 64, "open_windows": 3, "min_cut": 8, "fan_in": 2}])
def test_packing_round_trip(docs, options):
    got = packing.pack_sequences(docs.repartition(5), catalogue.tokenizer_path(), **options).toPandas()
    t, capacity = tokenizing.Tokenizer(catalogue.tokenizer_path()).library, options.get("capacity", 4096)
    want = collections.Counter()
    for r in docs.collect():
        want[(r.doc_id, zlib.crc32(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()))] += 1
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"))
    assert got["length"].sum() == sum(len(x) for xs in ids.values() for x in xs)
    for row in got[got.doc_id.notna() & (got.doc_id != 3)].itertuples():
        own = ids[int(row.doc_id)][0]
        assert zlib.crc32(own[row.start : row.start + row.length].tobytes()) == row.ids_crc32 and row.doc_tokens == len(own)
    for _, pieces in got.groupby("sequence_id"):
        pieces = pieces.sort_values("offset")
        assert pieces["offset"].tolist() == [0, *pieces["length"].cumsum().tolist()[:-1]]
        assert pieces["length"].sum() <= capacity
    assert (got.groupby("sequence_id")["length"].sum() > 0).all()


def test_packing_of_nothing(empty):
    assert packing.pack_sequences(empty, catalogue.tokenizer_path()).count() == 0


def test_little_padding(spark):
    many = spark.createDataFrame([(i, prose(int(50 + 37 * i % 900), i)) for i in range(300)], "doc_id long, text string").repartition(4)
    got = packing.pack_sequences(many, catalogue.tokenizer_path()).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("padded_tokens").alias("p")).agg(F.sum("n"), F.sum("p")).first()
    assert got[0] / got[1] > 0.95


# Mixing


def test_mixing_targets(docs):
    got = mixing.mix_digest(docs, bucket_rows=2).toPandas()
    assert len(got) == docs.count()
    sizes = collections.defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, target = 1.5 * sum(sizes.values()), {}
    open_ = set(sizes)
    while True:  # share, cap, share again
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    named = got.merge(docs.select("doc_id", "source").toPandas().drop_duplicates(), on="doc_id")
    assert (got["taken"] <= 2 * got["size"]).all()
    for r in named[named.doc_id.notna()].itertuples():
        assert r.target == pytest.approx(target[r.source])
    assert got["taken"].sum() == pytest.approx(budget, abs=len(sizes))
    again = mixing.mix_digest(docs.repartition(3), bucket_rows=1000).toPandas()
    assert sorted(map(tuple, got.drop(columns="virtual_finish").fillna(-1).values.tolist())) == sorted(map(tuple, again.drop(columns="virtual_finish").fillna(-1).values.tolist()))


def test_mix_keeps_columns(docs, empty):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert max(out.where("doc_id is not null and doc_id <> 3").groupBy("doc_id").count().toPandas()["count"]) <= 2
    assert mixing.mix(empty).count() == 0 and mixing.mix_digest(empty).count() == 0


# Secrets and personal data


def brute(patterns, keep, text):
    found = []
    for n, (kind, pattern, flags) in enumerate(patterns):
        found += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text or "", flags) if keep(kind, m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


SECRETS = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0), ("hex", r"[0-9a-f]+", 0)]
PRIVATE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0), ("card", r"[0-9]([\x20-]?[0-9])+", 0), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0)]


def secret(kind, m):
    return {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]()


def private(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    check = sum((lambda v: v - 9 if v > 9 else v)(int(c) * (2 if i % 2 else 1)) for i, c in enumerate(reversed(digits)))
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and check % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]


ODD = [
    "password: token: abcdefgh", "TOKEN = 'abcdef' secret=\"xyz\" api_key:AbC123==", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 13, "é" * 9 + "passwd=ß 日本 secret='abcdef0123'" + "a" * 30, "token=secret=abcdefgh",
    "a@b.c_d@e.f x@y.z é@x.yé", "1.2.3.4.5.6.7.8 1.2.3.256.7.8 0001.002.3.255", "4785380592391139 4785-3805-9239-1139 4785 3805 9239 1139 12", "+1 (499) 555-6503.. +12345678901234567 +1-2 日本+49 (30) 1234567",
    "1" * 3000 + " " + "a" * 3000 + "@", "a@b" + ".c" * 9000, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "+" * 100 + "1" * 12, "4785380592391139  " * 300, "ghp_" + "A1" * 18 + " xoxb-1234567890ab-abcdef12",
]


@pytest.mark.parametrize("digest, patterns, keep", [(secret_scan.secret_digest, SECRETS, secret), (pii.pii_digest, PRIVATE, private)])
def test_base_spans(spark, docs, empty, digest, patterns, keep):
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(odd)
    got = digest(both).toPandas()
    want = collections.Counter((r.doc_id, hashlib.sha256(brute(patterns, keep, r.text).encode()).hexdigest()) for r in both.collect())
    assert collections.Counter((None if i != i else int(i), h) for i, h in zip(got["doc_id"], got["base_sha256"], strict=True)) == want
    texts = {r.doc_id: r.text for r in both.where("doc_id is not null").collect()}
    for r in got[got.doc_id.notna()].itertuples():
        spans = r.spans.split(",") if r.spans else []
        assert set(filter(None, brute(patterns, keep, texts[r.doc_id]).split(","))) <= set(spans)
    assert digest(empty).count() == 0


def test_the_methods_own_spans(spark):
    made = spark.createDataFrame([(1, "write to john (at) mail (dot) com or call 555-123-4567"), (2, "order 555-123-4567 isbn 1234.5678.9012.3456"), (3, "ghp_" + "Zq" * 18)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.pii_digest(made).collect()}
    assert "email:9:33" in spans[1] and "phone:" in spans[1] and spans[2] == ""
    assert {r.doc_id: r.spans for r in secret_scan.secret_digest(made).collect()}[3] == "github:0:40"


def test_the_trees_choices_equal_a_slow_version(spark):
    texts = [t for _, t, _ in pii.invented(250, seed=5)] + ["a@b.io (at) c.de +49 555-123-4567 555-123-4567", "1111.2222.3333.4444 555-123-4567, (030) 123 4567; 2001:0db8:0000:0000:0000:ff00:0042:8329"]
    trees, cuts = pii.fitted(spark)
    got = {r.doc_id: r.spans for r in pii.pii_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    accepted = 0
    for i, text in enumerate(texts):
        strict = brute(PRIVATE, private, text)
        base = [tuple(map(int, x.split(":")[1:])) for x in strict.split(",") if x]
        more = slow.private_spans(text, base, trees, cuts)
        assert set(filter(None, got[i].split(","))) == set(filter(None, strict.split(","))) | {f"{k}:{a}:{b}" for k, a, b in more}, text
        accepted += len(more)
    assert accepted > 50


def test_secrets_of_all_rules_equal_a_slow_version(spark):
    r, parts = np.random.default_rng(3), ["ghp_" + "aB3" * 13, "xoxb-0123456789ab-abcdef12", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "-----BEGIN RSA PRIVATE KEY-----" + "Zz9+" * 20, "token=", "secret: 'abcdef", "AKIA" + "X" * 16, "f" * 30, "日本", " ", "\n", "plain"]
    texts = ["".join(parts[k] for k in r.integers(0, len(parts), r.integers(1, 9))) for _ in range(120)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.text for x in secret_scan.redact_secrets(made).collect()} == {i: slow.masked(t)[0] for i, t in enumerate(texts)}


def test_trigram_queries_hold_for_matches():
    def holds(q, text):
        return q is True or (q in text.lower() if isinstance(q, str) else (all if q[0] == "and" else any)(holds(x, text) for x in q[1]))

    hits = ["password=x", "PASSWD : 'y", "api_key=z", "apikey:1", "AKIA1", "ghp_" + "a" * 36, "xoxb-0123456789-abcdef", "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10]
    for rule, text in itertools.product((*secret_scan.BASE_RULES, *secret_scan.MORE_RULES), hits):
        if secret_scan.compiled(rule).search(text):
            assert holds(secret_scan.trigram_query(rule.pattern), text)
    assert secret_scan.trigram_query("[0-9a-f]+") is True
    assert secret_scan.trigram_query("(abcd|xyz)+q?") == ("or", (("and", ("abc", "bcd")), "xyz"))


def test_redaction(docs):
    out = secret_scan.redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r.doc_id: r for r in out.collect()}
    assert "AKIA" not in text[10].text and text[10].n_chars == len(text[10].text)
    assert text[4].text == BASE and text[0].text is None


# Near copies


def weighted(text):
    w = re.findall(r"\w+", (text or "").lower())
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter({("", text or ""): 1})


def classes_of(texts):
    label, sets = {i: i for i in texts}, {i: weighted(t) for i, t in texts.items()}
    for a, b in itertools.combinations(sorted(texts), 2):
        shared = sum((sets[a] & sets[b]).values())
        if shared >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - shared):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {k: new if v == old else v for k, v in label.items()}
    return label


def test_near_copies(spark, plain, docs, empty):
    chain, copies = [prose(200, 77)], []
    for k in range(6):  # each like the one before
        w = chain[-1].split()
        w[20 * k + 5] = f"new{k}"
        chain.append(" ".join(w))
    for k in range(60):  # a group larger than a block
        w = prose(150, 99).split()
        w[(7 * k) % 150] = f"edit{k}"
        copies.append(" ".join(w))
    texts = {r.doc_id: r.text for r in plain.collect()} | {100 + i: t for i, t in enumerate(chain)} | {200 + i: t for i, t in enumerate(copies)} | {400 + i: prose(100, 500 + i) for i in range(40)}
    made = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for block in (512, 8):
        got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(made, block=block).collect()}
        assert got == classes_of(texts)
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert ids == sorted(set(classes_of({r.doc_id: r.text for r in plain.collect()}).values()))
    assert neardup.near_duplicate_classes(empty).count() == 0 and neardup.keep_one_of_each(empty).count() == 0


def test_a_link_beside_a_forests_that_fail(spark):
    sets = {b"a": range(1, 11), b"b": [*range(1, 8), 11, 12, 13], b"c": [*range(1, 10), 20], b"d": range(50, 60)}  # only a and c are alike
    sig = np.zeros(neardup.COORDINATES, "<u2").tobytes()
    made = spark.createDataFrame([(k, np.array(sorted(v), "<u8").tobytes()) for k, v in sets.items()], "key binary, elements binary")
    met = spark.createDataFrame([(1, 0, 0, neardup.WITHIN, k, k, sig) for k in sets], "band long, block long, nth int, side int, key binary, label binary, sig binary")
    none = spark.createDataFrame([], "node binary, label binary")
    labels = {bytes(r.node): bytes(r.label) for r in neardup._settled(none, met, made, 0.8, 0.7).collect()}
    assert labels == {b"a": b"a", b"c": b"a"}
    later = met.withColumn("nth", F.lit(1))  # they have met in an earlier band
    assert neardup._settled(none, later, made, 0.8, 0.7).count() == 0


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    a, b, c, d = (prose(60, 900 + n) for n in range(4))
    rows = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (5, c, "x"), (5, d, "x"), (7, d + " more", "y"), (7, d + " more", "y"), (None, a, "z"), (None, prose(60, 990), "z"), (None, prose(60, 990), "z"), (9, None, "n"), (8, "", "n")]
    made = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    kept = neardup.keep_one_of_each(made)
    assert kept.columns == made.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, a), (1, b), (2, c), (5, d), (0, prose(60, 990)), (8, "")])


def test_untried_members_of_other_classes():
    r = np.random.default_rng(3)
    sig = r.integers(0, 2, (12, 40)).astype("<u2")
    label, tried = np.arange(12) % 5, np.zeros((12, 12), bool)
    tried[0, 1] = tried[1, 0] = True
    share = (sig[:, None] == sig[None]).mean(axis=2)
    want = {(i, j) for i in range(12) for j in range(i + 1, 12) if label[i] != label[j] and not tried[i, j] and share[i, j] >= 0.5}
    assert neardup.across(sig, label, tried, 0.5, 12) == want
    one, top = neardup.across(sig, label, tried, 0.5, 1), max(share[p] for p in want)
    assert one <= want and len(one) <= 12 and any(share[p] == top for p in one)


def test_signatures_estimate_similarity():
    a, b = prose(400, 5), " ".join([*prose(400, 5).split()[:300], *prose(400, 6).split()[:100]])
    import pyarrow as pa

    hashes, offsets = neardup.word_hashes(pa.array([a, b, "one two", ""]))
    doc, element = neardup.shingle_elements(hashes, offsets)
    sig = neardup.dart_signatures(doc, element, 4, k=2000)
    x, y = weighted(a), weighted(b)
    shared = sum((x & y).values())
    assert (sig[0] == sig[1]).mean() == pytest.approx(shared / (sum(x.values()) + sum(y.values()) - shared), abs=0.05)
    assert np.bincount(doc, minlength=4).tolist() == [396, 396, 1, 0]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame([(b, a) for a, b in chain], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)}


# Fingerprints


def test_fingerprints(docs, empty, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    many = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(None, prose(20 + i % 9, 700 + i % 40)) for i in range(60)], "doc_id long, text string"))
    for some in (many, many.where("doc_id is null"), many.where("doc_id is not null"), many.where("doc_id = 8")):
        in_order(fingerprints.fingerprint_digest(some.repartition(3)).toPandas(), some)
    got = fingerprints.fingerprint_digest(docs).toPandas()
    in_order(got, docs)
    assert got[got.doc_id == 4].fingerprint.item() == got[got.doc_id == 5].fingerprint.item()
    assert got["near_edited"].between(0, 1).all() and got["near_next"].between(0, 1).all()
    assert got[got.doc_id == 8].near_edited.item() > got[got.doc_id == 8].near_next.item()
    assert fingerprints.fingerprint_digest(empty).count() == 0


def in_order(got, docs):
    """Each row's edited text is made of it and of the next row in the defined order."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    ordered = sorted((r.doc_id is None, -(r.doc_id or 0), md5(r.text or "") if r.doc_id is None else "", r.text or "") for r in docs.collect())
    want = collections.Counter()
    for i, (none, minus, _, text) in enumerate(ordered):
        changed = fingerprints.edited(text, ordered[(i + 1) % len(ordered)][3])
        want[(None if none else -minus, len(text), hashlib.sha256(changed.encode()).hexdigest())] += 1
    assert collections.Counter((None if i is None or i != i else int(i), n, h) for i, n, h in zip(got["doc_id"], got["n_chars"], got["edited_sha256"], strict=True)) == want


def test_phrases_equal_a_slow_parser():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 400):
        texts = ["".join(r.choice(list("ab cdé日"), n)) for _ in range(6)] + ["a" * n, "ab" * n]
        rows = [fingerprints._mix(np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)) for t in texts]
        symbols, first = np.concatenate(rows), np.concatenate([np.arange(len(x)) == 0 for x in rows])
        rows = [x.tolist() for x in rows]
        for _ in range(3):
            symbols, first = fingerprints.parse_level(symbols, first)
            rows = [slow.phrases(x) for x in rows]
            assert symbols.tolist() == [name for x in rows for name in x]


def test_equal_substrings_share_phrases():
    text = prose(3000, 8)
    one = fingerprints.fingerprints([text])[0]
    assert all((a == b).all() for a, b in zip(fingerprints.fingerprints([text, "a", text]), [one, fingerprints.fingerprints(["a"])[0], one], strict=True))

    def phrases(t):
        symbols = fingerprints._mix(np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
        first = np.arange(len(symbols)) == 0
        for _ in range(3):
            symbols, first = fingerprints.parse_level(symbols, first)
        return set(symbols.tolist())

    whole = phrases(text)
    for shift in (1, 2, 7):
        assert len(whole & phrases("z" * 0 + prose(20, shift) + text[shift:])) > 0.97 * len(whole)
    assert fingerprints.likeness(np.zeros(0, np.uint32), np.zeros(0, np.uint32)) == 1.0 and fingerprints.likeness(one, np.zeros(0, np.uint32)) == 0.0
    assert len(fingerprints.fingerprints(["a" * 100_000])[0]) <= 2


# Nearest neighbours


def test_neighbours(spark):
    r = np.random.default_rng(4)
    vectors = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((1500, 32)))]
    same = [1.0] * 32
    odd = [(2000, None), (2050, [0.0] * 32), *[(i, same) for i in (2100, 2150, *range(2151, 2160), 2200, 2200)], (2250, [*[1.0] * 31, float("nan")]), (2300, [*[1.0] * 31, None]), (2350, [1.0] * 3), (None, same)]
    table = spark.createDataFrame([(*v, 7) for v in vectors + odd], "vec_id long, embedding array<float>, list int").repartition(3)
    got = ann.nearest_neighbours(table, F.col("vec_id") % 50 == 0).toPandas()
    good = {i: np.array(v, np.float32).astype(float) for i, v in vectors} | {i: np.array(same) for i, v in odd if v == same and i is not None}
    ids, x = np.array(sorted(good)), np.array([good[i] for i in sorted(good)])
    hits = 0
    for q in [i for i in good if i % 50 == 0]:
        score = (x * good[q]).sum(1) / np.sqrt((x * x).sum(1) * (good[q] ** 2).sum())
        score[ids == q] = -9
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and q not in own.vec_id.tolist()
        assert own.score.tolist() == pytest.approx(score[np.searchsorted(ids, own.vec_id)].tolist(), abs=1e-12)
        hits += len(set(own.vec_id) & set(ids[np.lexsort((ids, -score))[:5]]))
    assert hits / (5 * len([i for i in good if i % 50 == 0])) >= 0.9
    assert got[got.query_id == 2150].sort_values("rank").vec_id.tolist() == [2100, 2151, 2152, 2153, 2154]
    assert set(got.query_id) == {i for i in good if i % 50 == 0}


def test_equal_directions_and_ties_go_to_smaller_ids(spark):
    r = np.random.default_rng(8)
    base = r.standard_normal(16).astype(np.float32).astype(float)
    rows = [(0, base.tolist()), *[(i, (base * 2.0 ** (i % 9 - 4)).tolist()) for i in range(1, 25)], *[(100 + i, v.tolist()) for i, v in enumerate(r.standard_normal((400, 16)))]]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [g.vec_id for g in got] == [1, 2, 3, 4, 5] and {g.score for g in got} == {got[0].score}
    axes = [(i, [float(k == i % 8) for k in range(8)]) for i in range(8, 80)]  # all as near to the query as each other
    got = ann.nearest_neighbours(spark.createDataFrame([(0, [1.0] * 8), *axes], "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [g.vec_id for g in got] == [8, 9, 10, 11, 12]


def test_double_precision_of_any_size(spark):
    r = np.random.default_rng(9)
    vectors = {i: v for i, v in enumerate(r.standard_normal((60, 8)))}
    vectors |= {60: vectors[1] * 1e-300 + 0, 61: vectors[2] * 1e300, 62: vectors[3] * 1e-60, 63: vectors[4] * 1e40}
    got = ann.nearest_neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>"), F.col("vec_id") < 5).collect()
    unit = {i: (v / np.abs(v).max()) / np.sqrt(((v / np.abs(v).max()) ** 2).sum()) for i, v in vectors.items()}
    assert len(got) == 25 and all(g.score == pytest.approx(float(unit[g.query_id] @ unit[g.vec_id]), abs=1e-14) for g in got)
    first = {g.query_id: g.vec_id for g in got if g["rank"] == 1}
    assert [first[q] for q in (1, 2, 3, 4)] == [60, 61, 62, 63]


def test_few_or_no_neighbours(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert ann.nearest_neighbours(make([]), F.col("vec_id") % 50 == 0).count() == 0
    got = ann.nearest_neighbours(make([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]), F.col("vec_id") % 50 == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (2, 1)]


# Classifiers


def test_toxicity_held_out(spark):
    bad = ["idiot", "moron", "scum"]
    made = [(i, prose(60, i) + (f" {bad[i % 3]} {bad[(i + 1) % 3]}x" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in made] + [(9000, None), (9001, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, _, y in made], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, marks).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [(i, y) for i, _, y in made if got[i].held_out]
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.95
    assert got[9000].predicted == 0 and got[9000].score == got[9001].score
    flipped = spark.createDataFrame([(i, 1 - y if got[i].held_out else y) for i, _, y in made], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}  # held-out labels play no part


def test_toxicity_edges(docs, empty, labels):
    assert toxicity.toxicity_scores(docs, labels).count() == docs.count()
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0}


def test_quality(spark, docs, empty, labels):
    good = [(i, prose(50, i), "en", f"s{i % 3}") for i in range(200)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in prose(50, i).split()), "en", f"s{i % 3}") for i in range(80)]
    made = spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in (good + junk)[::2]], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(made, marks).collect()}
    assert all(r.keep == int(i < 1000) for i, r in got.items())
    assert sorted(r.doc_id for r in quality.keep_good(made, marks).collect()) == list(range(200))
    hosts = {r.host_posterior for r in got.values()}
    assert all(0.5 < h < 0.9 for h in hosts)
    assert quality.quality_scores(docs, labels).count() == docs.count() and quality.keep_good(docs, labels).columns == docs.columns
    assert quality.quality_scores(empty, labels).count() == 0 and quality.keep_good(empty, labels).count() == 0
    assert {r.own for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_sparse_sites_shrink_to_their_host(spark):
    scored = spark.createDataFrame([("a", "p", 0.9)] * 50 + [("a", "q", 0.1)] + [("b", "p", 0.2)] * 50 + [(None, None, 0.5)], "host string, path string, own double")
    got = {(r.host, r.path): r for r in quality.group_posteriors(scored).collect()}
    assert 0.1 < got[("a", "q")].path_posterior < got[("a", "q")].host_posterior
    assert got[("a", "p")].path_posterior > 0.8 and got[("b", "p")].path_posterior < 0.3


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert got[12].licenses == "mit" and got[12].spans == "mit:0:31"
    assert all(r.n_found == 0 for i, r in got.items() if i != 12)
    assert licenses.license_scan(empty).count() == 0
    c = licenses.Classifier()
    assert c.held_out > 0.9
    assert [c(t)[0] for t in ("Licensed under the Zorble License.", "The license plate of the car.", "Licensed under CC BY-NC 4.0.")] == ["unknown", "none", "cc-by-nc"]
    long_line = prose(500, 1) + " Licensed under the Apache License, Version 2.0. " + prose(500, 2)
    assert {f for *_, f in licenses.scan(long_line, c)} == {"apache-2.0"}
