import hashlib
import random
import re
import struct
import zlib

from tidemark.llm import language, media, pii, secrets

from . import fixtures as fx

# ---- media


def test_op3_against_hashes(spark, tmp_path):
    rows = {(i, n): (p, s, z) for i, n, p, s, z in ((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.query(spark, fx.saved(fx.odd(spark), tmp_path)).collect())}
    for i, text, *_ in fx.odd_rows():
        data = (text or "").encode()
        full = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert rows[(i, len(data))] == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert media.query(spark, fx.saved(fx.empty(spark), tmp_path)).count() == 0


def test_payloads_of_many_chunks_come_back():
    for n in (64, 65536, 65600, 300_032):
        payload = random.Random(n).randbytes(n)
        data = media.encode(payload)
        assert media.read_payload(data) == payload
        x = media.describe(data)
        assert x["codec"] == "raw " and x["samples"] == n and x["duration"] == n / 8000
        assert sum(m for _, m in x["keyframes"]) == n


def test_keyframes_of_a_track_with_sync_samples():
    sizes, sync = [5, 3, 7, 2, 9, 4], [1, 4]
    stbl = media.box(
        "stbl",
        media.full("stsd", struct.pack(">I", 1), media.box("avc1", bytes(8))),
        media.full("stts", struct.pack(">III", 1, 6, 40)),
        media.full("stss", struct.pack(">I2I", 2, *sync)),
        media.full("stsc", struct.pack(">I", 2), struct.pack(">III", 1, 2, 1), struct.pack(">III", 2, 4, 1)),
        media.full("stsz", struct.pack(">II6I", 0, 6, *sizes)),
        media.full("co64", struct.pack(">I2Q", 2, 1000, 5000)),
    )
    mdhd = media.full("mdhd", struct.pack(">QQIQ", 0, 0, 600, 1200), version=1)
    data = media.box("moov", media.box("trak", media.box("mdia", mdhd, media.box("minf", stbl)))) + struct.pack(">I4sQ", 1, b"free", 16)
    x = media.describe(data)
    assert (x["codec"], x["duration"], x["keyframes"]) == ("avc1", 2.0, [(1000, 5), (5007, 2)])
    four = media.full("stz2", bytes([0, 0, 0, 4]), struct.pack(">I", 3), bytes([0x12, 0x30]))
    t = media.tracks(media.box("moov", media.box("trak", media.box("mdia", media.box("minf", media.box("stbl", four))))))[0]
    assert list(t.sizes) == [1, 2, 3]


def test_damaged_containers_have_errors(spark):
    rows = [(1, None, "x"), (2, b"", "x"), (3, b"nonsense that is no box", "x"), (4, media.encode(bytes(64))[:100], "x")]
    out = media.describe_media(spark.createDataFrame(rows, "id int, media binary, error string")).collect()
    assert all(r.codec is None and r.error for r in out)


# ---- languages


def test_held_out_accuracy_and_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95


def test_mixed_text_is_cut_where_languages_change(spark):
    r = random.Random(1)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(n))
    rows = [(i, make("abcdef", 60), "x", "s") for i in range(0, 40, 2)] + [(i, make("uvwxyz", 60), "y", "s") for i in range(1, 40, 2)] + [(i, make("абвгде", 60), "ru", "s") for i in range(40, 60)]
    model = language.fit(fx.table(spark, rows).select("doc_id", "text", "lang"))
    a, b, c = make("abcdef", 20), make("uvwxyz", 30), make("абвгде", 5)
    ((lang, score, spans),) = model.label([f"{a} 12 {b} {c}"])
    assert (lang, [s[0] for s in spans]) == ("y", ["x", "y", "ru"])
    assert spans[0][1:] == (0, len(a)) and abs(score - 30 / 55) < 1e-9
    assert model.label(["", "123 !!"]) == [("und", 0.0, [])] * 2
    best = model.path(model.word_scores(w := language.read_words([f"{a} {b}"])))
    assert len(best) == len(w.first)


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    r = np.random.default_rng(2)
    m = language.Model(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool), switch=2.0)
    for _ in range(60):
        s = r.normal(0, 2, (6, 3))
        value = lambda p: sum(s[t, x] for t, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
        assert abs(value(m.path(s)) - max(map(value, itertools.product(range(3), repeat=6)))) < 1e-9


def test_odd_rows_and_nothing_to_learn_from(spark):
    docs = fx.odd(spark)
    model = language.fit(docs.select("doc_id", "text", "lang"))
    assert language.label_documents(docs, model).count() == docs.count()
    none = language.fit(fx.empty(spark).select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language.label_documents(docs, none).collect()} == {"und"}


# ---- personal data and secrets

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(t):
    digits = lambda m: sum(c.isdigit() for c in m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= digits(m) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= digits(m) <= 15]


def test_base_spans_are_the_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("0123451.@+- ()ab%.") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == plain_pii(t)


def test_field_sees_entities_behind_long_runs_without_a_space():
    weights = pii.trained()
    entities = ["123-45-6789", "(212) 555-0187", "jane.doe (at) mail (dot) com", "jane.doe[at]mail[dot]com"]
    for entity in entities:
        for lead in ["a,b;" * 15, "日本語、" * 15, "x/" * 40 + "\n", "é" * 90 + ",", "one\n" * 20, '{"k":"' + "v" * 60 + '","n":"']:
            text = f"{lead}{entity} next"
            toks = pii.tokens(text, 0, len(text))
            whole = [(kind, toks[i][0], toks[j - 1][1]) for i, j, kind in pii.best(weights, len(toks), pii.candidates(text, toks))]
            assert pii.field_spans(text, weights) == whole and whole, (lead, entity)
    assert pii.field_spans("a,b;" * 15 + "123-45-6789 next", weights) == [("national_id", 60, 71)]
    name = "n" * 50
    assert pii.field_spans(f"mail {name} (at) ab (dot) com", weights) == [("email", 5, 5 + len(f"{name} (at) ab (dot) com"))]


def test_field_on_sentences_it_has_not_seen():
    weights, r = pii.trained(), random.Random(99)
    hit = wrong = missed = 0
    for _ in range(200):
        text, gold = pii.made_sentence(r)
        found = set(pii.field_spans(text, weights))
        hit, wrong, missed = hit + len(found & set(gold)), wrong + len(found - set(gold)), missed + len(set(gold) - found)
    assert hit / (hit + wrong) > 0.9 and hit / (hit + missed) > 0.85
    assert pii.field_spans("Call (212) 555-0187 or write jane.doe (at) mail (dot) com.", weights) == [("phone", 5, 19), ("email", 29, 57)]


def test_decoding_is_the_best_of_all_choices():
    weights, r = pii.trained(), random.Random(4)
    for _ in range(60):
        text, _ = pii.made_sentence(r)
        toks = pii.tokens(text, 0, len(text))[:12]
        cands = [c for c in pii.candidates(text, toks)][:9]
        rows = [max(row) for row in pii._scores(weights, cands)]

        def value(pick):
            spans = sorted((cands[i][0], cands[i][1], rows[i]) for i in pick)
            if any(b > c for (_, b, _), (c, _, _) in zip(spans, spans[1:])):
                return None
            return sum(s for _, _, s in spans) + weights["touch"] * sum(b == c for (_, b, _), (c, _, _) in zip(spans, spans[1:]))

        top = max(v for k in range(1 << len(cands)) if (v := value([i for i in range(len(cands)) if k >> i & 1])) is not None)
        where = {(i, j): n for n, (i, j, _) in enumerate(cands)}
        assert abs(value([where[i, j] for i, j, _ in pii.best(weights, len(toks), cands)]) - top) < 1e-9


def test_op5_digests(spark, tmp_path):
    texts = ["mail a.b@c.org or +1 (017) 555-7713, ip 10.0.0.255 no 300.1.1.1", "4111 1111 1111 1111 and 4111111111111112", None, "", "plain"]
    at = fx.saved(fx.table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), tmp_path)
    for row in pii.query(spark, at).collect():
        base = sorted(plain_pii(texts[row.doc_id] or ""), key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(row.spans.split(","))
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(x[0] == k for x in base) for k in pii.BASE_KINDS)
    odd = fx.odd(spark)
    assert pii.find_spans(odd).columns == [c for c in odd.columns if c not in ("text", "spans")] + ["spans"]
    assert pii.find_spans(odd).count() == odd.count() and pii.find_spans(fx.empty(spark)).count() == 0


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(t):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24], key=lambda x: (x[1], secrets.KINDS.index(x[0])))


SECRETS = ["token = '04dbebab91ab85687d33eeaaf9ac699e'", "PassWord:hunter22 x", "AKIA" + "Z" * 16 + " AKIAshort", "api_key=abc toKen: Key", None, "", "x password=longenough secret=short1 token=abcde"]


def test_op6_digests(spark, tmp_path):
    at = fx.saved(fx.table(spark, [(i, t, "en", "a") for i, t in enumerate(SECRETS)] + [(50, SECRETS[0], "en", "a")]), tmp_path)
    rows = secrets.query(spark, at).collect()
    assert len(rows) == len(SECRETS) + 1
    for row in rows:
        base = plain_secrets(SECRETS[row.doc_id % 50] or "")
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(x[0] == k for x in base) for k in secrets.KINDS[:3])


def test_ledger_scans_only_unseen_blobs_and_rule_versions(spark, tmp_path):
    ledger = secrets.Ledger(spark, f"{tmp_path}/ledger")
    day = lambda rows: spark.createDataFrame(rows, "path string, version int, text string, blob int")
    first = secrets.scan(day([("a", 1, SECRETS[0], 0), ("b", 1, SECRETS[0], 0), ("c", 1, "clean", 0)]), ledger)
    assert {r.path: len(r.findings) for r in first.collect()} == {"a": 2, "b": 2, "c": 0}
    assert ledger.read().count() == 2
    second = secrets.scan(day([("a", 2, SECRETS[1], 0), ("d", 1, SECRETS[0], 0)]), ledger)
    assert {r.path: len(r.findings) for r in second.collect()} == {"a": 1, "d": 2}
    assert ledger.read().count() == 3  # the old blob wasn't scanned again
    secrets.scan(day([("a", 3, SECRETS[0], 0)]), ledger, rule_version="next").collect()
    assert ledger.known("next").count() == 1
    odd = fx.odd(spark)
    assert secrets.scan(odd, secrets.Ledger(spark, f"{tmp_path}/odd")).count() == odd.count()
    assert secrets.scan(fx.empty(spark), secrets.Ledger(spark, f"{tmp_path}/none")).count() == 0


def test_a_blob_that_is_twice_in_the_ledger_gives_one_row(spark, tmp_path):
    from tidemark.llm import secrets

    versions = spark.createDataFrame([("a", "password = hunter22"), ("b", "none")], "path string, text string")
    ledger = secrets.Ledger(spark, f"{tmp_path}/ledger")
    first = sorted(map(repr, secrets.scan(versions, ledger).collect()))
    ledger.read().write.mode("append").partitionBy("rule_version").parquet(f"{tmp_path}/again")
    spark.read.schema(ledger.SCHEMA).parquet(f"{tmp_path}/again").write.mode("append").partitionBy("rule_version").parquet(ledger.path)
    assert ledger.read().count() == 4 and ledger.known(secrets.RULE_VERSION).count() == 2
    assert sorted(map(repr, secrets.scan(versions, ledger).collect())) == first and len(first) == 2


def test_odd_containers_and_names(spark):
    deep = b""
    for _ in range(1200):
        deep = media.box("moov", deep)
    good = media.encode(b"x" * 64)
    fragment = good + media.box("moof", media.box("traf"))
    stbl = lambda *sync: media.box("moov", media.box("trak", media.full("hdlr", bytes(4), b"vide"), media.full("stsz", struct.pack(">II", 4, (1 << 32) - 1)), media.full("stsc", struct.pack(">IIII", 1, 1, (1 << 32) - 1, 1)), media.full("stco", struct.pack(">II", 1, 100)), media.full("stss", struct.pack(f">I{len(sync)}I", len(sync), *sync))))
    assert "deep" in media.describe(deep)["error"]
    assert "fragmented" in media.describe(fragment)["error"]
    assert media.describe(stbl(1, 2, 11))["keyframes"] == [(100, 4), (104, 4), (140, 4)]
    assert media.describe(stbl(0))["error"]
    both = media.describe(good + stbl(2))
    assert [t["handler"] for t in both["tracks"]] == ["soun", "vide"] and both["handler"] == "vide"
    df = spark.createDataFrame([(good, 1), (deep, 2), (None, 3)], "media binary, `a.b``c` int")
    assert media.describe_media(df).columns[0] == "a.b`c" and media.describe_media(df).filter("error IS NULL").count() == 1
    docs = spark.createDataFrame([("mail a@b.cd", 1)], "text string, `a.b``c` int")
    assert pii.find_spans(docs).columns == ["a.b`c", "spans"] and pii.find_spans(docs).first()[0] == 1


def test_marks_without_a_letter_are_no_word():
    assert len(language.read_words(["\u0301", "\u093e 12", " \u0301\u0302 "]).first) == 0
    assert len(language.read_words(["a\u0301 \u0301 \u0301b"]).first) == 2
