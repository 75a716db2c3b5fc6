"""Operators on documents against plain loops, over nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from llm_tables import PROSE, SCHEMA, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vaultry.llm import bpe, lexicon, mixing, rules, secrets, simhash, token_files, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# rules


def measured(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_rules(odd, none):
    got = rules.verdicts(rules.ledger(odd.withColumnRenamed("lang", "n_words"), carry=("doc_id", "text"))).collect()
    assert len(got) == odd.count()
    for r in got:
        expected = measured(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert r.kept <= (not r.base_failed)
    assert rules.ledger(none).count() == 0


def test_ablations(odd, none):
    ledger = rules.ledger(odd)
    bits = [r.failed_bits for r in ledger.collect()]
    rows = {(r.policy, r.rule): r for r in rules.ablations(ledger).collect()}
    for policy in rules.POLICIES:
        for rule in rules.RULES:
            if not policy.mask >> rule.bit & 1:
                assert (policy.version, rule.name) not in rows
                continue
            r, bit = rows[policy.version, rule.name], 1 << rule.bit
            assert (r.n_docs, r.n_failed) == (len(bits), sum(b & bit > 0 for b in bits))
            assert r.n_only == sum(b & policy.mask == bit for b in bits)
            assert r.n_rejected == sum(b & policy.mask > 0 for b in bits)
    assert rules.ablations(rules.ledger(none)).count() == 0


# SimHash


def brute_fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, bits=2):
    root = {f: f for f in set(fps)}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fs = list(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


def test_survivors_of_shared_keys(spark):
    """Rows that share a key but not a text stand for their own groups."""
    rng = np.random.default_rng(6)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(3))
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (3, a, "en", "s", 1), (5, c, "en", "s", 1), (5, c, "en", "s", 1)]
    got = simhash.survivors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(3, a), (5, b), (5, c)])


def test_simhash(spark, odd, none):
    rows = odd.where("text IS NULL OR length(text) < 10000").select("doc_id", "text").collect()
    got = simhash.grouped(odd.where("text IS NULL OR length(text) < 10000")).collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    of = classes(fps)
    least = {}
    for r, f in zip(rows, fps):
        if r.doc_id is not None:
            least[of[f]] = min(least.get(of[f], r.doc_id), r.doc_id)
    expected = sorted((r.doc_id if r.doc_id is not None else -1, f"{f:016x}", least[of[f]]) for r, f in zip(rows, fps))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got) == expected
    assert simhash.grouped(none).count() == 0
    kept = simhash.survivors(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and 1 not in ids


def test_close_pairs_in_full_blocks(spark):
    """More fingerprints in one block than are compared directly, on every level."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    fps = {base}
    while len(fps) < 700:  # few bits vary, so blocks of 32 and of 48 fixed bits are full
        fps.add(base ^ int(rng.integers(0, 1 << 10)))
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 100)} | {-5, -6}
    fps = sorted(fps)
    df = spark.createDataFrame([(f, f) for f in fps], "fp long, rep long")
    got = {tuple(sorted((r.u, r.v))) for r in simhash.close_pairs(df).collect()}
    mask = (1 << 64) - 1
    expected = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & mask).bit_count() <= 2}
    assert got == expected


# tokens


def test_lexicon():
    entries = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(["a", "ab", "abc", "b", "bc", "xbc", "ü", "üb", "zzzz"])}
    lex = lexicon.Lexicon.of(lexicon.compiled(entries))
    asked = [*entries, b"", b"x", b"abcd", b"zz", b"\xc3"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(a) for a in asked])
    ranks = lex.ranks(data, ends - [len(a) for a in asked], np.asarray([len(a) for a in asked]))
    for word, rank in zip(asked, ranks.tolist()):
        assert (lex.lists(np.asarray([rank]))[0].as_py() if rank >= 0 else None) == entries.get(word)
    # shared suffixes: fewer arcs than letters
    many = {f"{a}{b}ing".encode(): [1] for a in "abcdef" for b in "uvwxyz"}
    assert len(lexicon.Lexicon.of(lexicon.compiled(many)).keys) == 6 + 6 + 3
    assert len(lexicon.Lexicon.of(lexicon.compiled({}))) == 0


def test_bpe_equals_the_library(spark, odd, none):
    got = bpe.encode(odd.withColumnRenamed("lang", "row"), PATH).collect()
    assert len(got) == odd.count()
    for r in got:
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode(none, PATH).count() == 0


def test_merging_random_text():
    rng = np.random.default_rng(5)
    letters = list("ab c\n\t.,'s1é漢  \x85<>") + ["<|endoftext|>", "'ll", " the"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(500)] + ["z" * 3000, "ab" * 2000]
    merges = bpe.merger(PATH)
    assert merges.chunks(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    pieces = [b"a", b"aaaaaaa", b" hello", "é漢".encode(), b""]
    assert merges.pieces(pieces) == [merges.piece(p) for p in pieces]


def test_token_files(spark, odd, none):
    files = token_files.write(odd, PATH, files=4)
    got = token_files.checksums(token_files.read(spark, files)).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(ids) == odd.count()
    start, by_id = 0, {}
    for r in got:
        assert r.start == start
        start += r.n_tokens
        by_id.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    expected = {}
    for r in odd.collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [0]
        expected.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in by_id.items()} == {k: sorted(v) for k, v in expected.items()}
    one = token_files.read(spark, files, F.col("doc_id") == 5)
    assert [r.doc_id for r in one.collect()] == [5] and "doc_id" in one._jdf.queryExecution().toString()
    assert token_files.read(spark, token_files.write(none, PATH)).count() == 0


# mixing


def test_mix_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 0, "é": 40, None: 7}
    df = spark.createDataFrame([(i, s, n, 0) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long, hash long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, targets, open_ = sum(sizes.values()), {}, set(sizes)
    while True:  # the excess is shared again until none is above
        left = total - sum(targets.values())
        share = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / share > 3 * sizes[s]}
        if not over:
            targets |= {s: left * weight[s] / share for s in open_}
            break
        targets |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    assert got == pytest.approx(targets)


def test_mix(spark, odd, none):
    texts = [" ".join(["w"] * (1 + i * 7 % 50)) for i in range(300)]
    docs = documents(spark, texts, sources=("a", "a", "a", "b", None)).unionByName(documents(spark, [None, ""], 900))
    got = mixing.mixed(docs).collect()
    assert len(got) == 302
    taken = Counter()
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source] += r.taken
    for r in got:
        assert r.target - 50 <= taken[r.source] <= r.target + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(7)).collect()))
    copies = Counter(r.doc_id for r in mixing.repeated(docs).collect())
    assert all(copies[r.doc_id] == (r.copies if r.size else 1) for r in got)
    assert mixing.repeated(docs).columns == docs.columns
    assert mixing.mixed(odd).count() == odd.count()
    assert mixing.mixed(none).count() == 0 and mixing.repeated(none).count() == 0


# secrets


def test_secret_candidates(spark):
    """A key name in front of '=' is not part of the value; dotted tokens are whole; '=' is padding."""
    value, jwt = "9f8a7b6c5d4e3f2a1b0c9d8e", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    texts = {f"API_KEY={value}": [value], f"export AWS_SECRET_ACCESS_KEY={value}": [value], f"SECRET_TOKEN_2={value} x": [value],
             f"see http://a.b/c?token={value}&x=1": [value], f"auth: {jwt} end": [jwt], "pad abcdefgh1234abcd== end": ["abcdefgh1234abcd=="],
             "abcdefghij1=": ["abcdefghij1="], f"password={value}={value}": [value, value], "key_name_only_2=x": []}
    words = ["word"]
    rows = secrets.with_candidates(documents(spark, list(texts)), words).select("text", "_found").collect()
    for r in rows:
        assert [c.value for c in r._found] == texts[r.text], r.text
        if "==" not in r.text and r._found and r.text != "abcdefghij1=":
            assert r._found[0].key_word == 1
    found = secrets.with_candidates(documents(spark, list(texts)), words).select("text", F.inline("_found"))
    labels = {r.text: r.secret for r in secrets.seed_labels(found).where("nth = 1").collect()}
    assert all(labels[t] == 1 for t in texts if value in t)


def test_secrets(spark, odd, none):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [f'some words token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and more' for i in range(40)]
    texts += [f"card number {4785380592390000 + i} was charged" for i in range(40)]
    texts += [f"see commit {hashlib.md5(str(i).encode()).hexdigest()} for it" for i in range(20)]
    docs = documents(spark, texts)
    model = secrets.fit(docs)
    asked = documents(spark, [f'now the api_key = "{key}" is out', "card 4785380592391135 paid", f"plain words\n{PROSE}", None, ""])
    got = {(r.doc_id, r.nth): r for r in secrets.findings(asked, model).collect()}
    assert set(got) == {(0, 1), (1, 1)} and got[0, 1].is_secret and not got[1, 1].is_secret
    assert got[0, 1].value_sha256 == hashlib.sha256(key.encode()).hexdigest()
    clean = {r.doc_id: r.text for r in secrets.masked(asked, model).collect()}
    assert clean == {0: 'now the api_key = "[SECRET]" is out', 1: "card 4785380592391135 paid", 2: f"plain words\n{PROSE}", 3: None, 4: ""}
    odd_rows = secrets.masked(odd.withColumnRenamed("lang", "_found"), model)
    assert odd_rows.count() == odd.count() and odd_rows.columns[2] == "_found"
    assert secrets.findings(none).count() == 0 and secrets.masked(none).count() == 0


def test_forest_sql_equals_the_library(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(3)
    names = ["length", "digits", "hex"]
    rows = [(float(a > 0.5 or b > 0.8), *map(float, (a, b, c))) for a, b, c in rng.random((300, 3))]
    df = spark.createDataFrame(rows, "secret double, length double, digits double, hex double")
    vec = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    model = RandomForestClassifier(labelCol="secret", numTrees=1, maxDepth=4, seed=1, bootstrap=False).fit(vec)
    sql = secrets.forest_sql(model.toDebugString, names)
    both = model.transform(vec).withColumn("c", F.struct(*names)).withColumn("score", F.expr(sql))
    assert both.where("prediction <> score").count() == 0


# toxicity


def test_toxicity(spark, none):
    rng = np.random.default_rng(4)
    filler = [f"filler{i}" for i in range(60)]
    texts, toxic = [], []
    for i in range(600):
        body = list(rng.choice(filler, 12))
        bad = i % 4 == 0
        if i % 8 == 4:
            body.insert(3, "vileword")
        if bad or i % 11 == 0:  # labels go along with mentions, insulting or not
            body.insert(5, "muslims")
        texts.append(" ".join(body) + ".")
        toxic.append(int(bad))
    docs = documents(spark, [*texts, None, "", "the muslims met filler1", "the people met filler1", "a vileword"])
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert held == [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].predicted == (i % 8 == 4) for i in held)
    assert got[604].predicted == 1 and got[600].score == got[601].score
    free = {r.doc_id: r for r in toxicity.scored(docs, toxicity.fit(docs, labels, toxicity.Settings(swap_penalty=0.0))).collect()}
    # the penalty takes the effect of naming a group away
    assert got[602].predicted == 0 and free[602].predicted == 1
    assert abs(got[602].score - got[603].score) < 0.05
    blank = toxicity.scored(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert all(r.score == 0.5 for r in blank)
    assert toxicity.scored(none, toxicity.fit(none, labels)).count() == 0
