from __future__ import annotations

import base64
import bz2
import gzip
import json
import lzma
import re
import struct
import time
import zlib
from urllib.parse import quote

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quillon.llm import language_id, pieces, secrets, toxicity
from quillon.llm import words as words_module
from quillon.llm.memory import ENTRY, Recent
from quillon.llm.shared import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, extra int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


# --- secrets


def plain_matches(text):
    found = []
    for kind, pattern, least, group, flags in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, re.I | re.A),
        ("access", "AKIA[A-Z0-9]+", 20, 0, 0),
        ("hex", "[0-9a-f]+", 24, 0, 0),
    ):
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_are_the_plain_ones(texts):
    extra = ["", "token: token: abcdef", "secret= 'abc' secret=abcdefg", "ſecret=abcdefgh", "İ password=abcdef1", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "0" * 24, "é" * 3 + "api_key=123456"]
    for text in [*texts.values(), *extra]:
        assert secrets.scan(text)[0] == plain_matches(text)


SECRET = 'password="hunter2hunter"'


@pytest.mark.parametrize(
    "wrap",
    [
        quote,
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode())).decode(),
    ],
)
def test_layers_are_unwrapped_and_mapped(wrap):
    for inner in (SECRET, wrap(SECRET)):
        text = f"né {wrap(inner)} end"
        base, spans, layers, _ = secrets.scan(text)
        assert not base and layers >= 1
        assert any(kind == "assign" and 3 <= a < b <= len(text) - 4 for kind, a, b in spans)


def test_layers_that_give_themselves_back_end():
    text = quote(quote(quote("%41%2541")))
    assert secrets.scan(text)[2] < 10


def test_encoded_runs_that_repeat_are_each_reported():
    secret = b"password=hunter2hunter2x"
    b64 = lambda raw: base64.b64encode(raw).decode()
    percent = lambda s: "".join(f"%{ord(c):02x}" for c in s)
    runs = [b64(secret), percent(secret.decode()), b64(b64(secret).encode()), percent(b64(secret)), "".join(f"\\x{c:02x}" for c in secret)]
    rng = np.random.default_rng(5)
    for _ in range(60):
        text, wanted = "", set()
        for k in rng.integers(0, len(runs), 6):
            text += rng.choice(["né, ", "x y ", "12; "])
            wanted.add(("assign", len(text), len(text) + len(runs[k].rstrip("="))))
            text += runs[k] + " . "
        assert set(secrets.scan(text)[1]) == wanted


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        ("é password: %68unter22 end", 2, 22),
        ('secret="%73ecret99"', 0, 18),
        ("%70assword = hunter22", 0, 21),
        ('{"password": "\\u0068unter22"}', 2, 27),
        ("\\x70assword: 'hunter22'", 0, 22),
        ("?name=%E9t%E9&token=%61bcdefgh", 14, 30),
        ("%e2%82 %C3%A9 %F0%9F%98%80 token=%61bcdefgh", 27, 43),
        ("token='%5Cx61bcdefgh'", 0, 20),
    ],
)
def test_codes_are_decoded_in_the_whole_text(text, start, end):
    assert ("assign", start, end) in secrets.scan(text)[1]


def b64(raw, width=0):
    run = base64.b64encode(raw).decode()
    return "\n".join(run[k : k + width] for k in range(0, len(run), width)) if width else run


ZIPS = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress]
NOISE = np.random.default_rng(7).integers(0, 256, 3000, np.uint8).tobytes()


@pytest.mark.parametrize("pack", ZIPS)
def test_compressed_data_is_followed_to_the_end(pack):
    plain, secret = pack(b"nothing here, really"), SECRET.encode()
    encoded = [
        b64(pack(pack(pack(secret)))),
        *[b64(pack(z(secret))) for z in ZIPS],
        *[b64(plain + z(secret)) for z in ZIPS],
        b64(pack(secret[:7]) + pack(secret[7:])),
        b64(plain + secret),
        b64(pack(NOISE + secret), 76),
        b64(pack(pack(NOISE + secret)), 64).replace("\n", "\r\n  "),
        "".join(f"%{c:02X}" for c in pack(secret)),
        quote(pack(pack(secret)), safe=""),
        "".join(f"\\x{c:02x}" for c in pack(secret)),
        "".join(f"\\u{c:04x}" for c in pack(secret)),
    ]
    for run in encoded:
        for text in (f"né: {run} . end", f"né: {run} . {run} . end"):
            found = {(a, b) for kind, a, b in secrets.scan(text)[1] if kind == "assign"}
            assert found and all(4 <= a < b <= len(text) - 6 for a, b in found)
            assert text.count(run) == len({a > 6 + len(run) for a, _ in found})


def test_compressed_bytes_are_not_read_as_text():
    run = b64(gzip.compress(b"one, two. " * 400000))
    assert secrets.scan(f"x {run} y")[1] == []


def test_base64_over_line_breaks_is_joined():
    for before in (b"", b"x", "éèé".encode() * 9, b"word " * 20):
        for width in (19, 20, 64, 76):
            text = "-----BEGIN PRIVATE KEY-----\n" + b64(before + SECRET.encode() + b" etc.", width) + "\n-----END"
            spans = secrets.scan(text)[1]
            whole = [(a, b) for _, a, b in spans if len(text[a:b].replace("\n", "")) >= len(b64(SECRET.encode()[:-1])) - 3]
            assert whole, (before, width)


def test_long_content_is_scanned_in_windows(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 5000, raising=False)
    monkeypatch.setattr(secrets, "OVERLAP", 500, raising=False)
    noise, words = NOISE * 5, b"one, two. " * 800
    for inner in (SECRET.encode(), b64(gzip.compress(noise + SECRET.encode())).encode(), gzip.compress(noise + SECRET.encode()), b64(noise + SECRET.encode()).encode()):
        for at in (0, 4980, 7990):
            text = "x " + b64(gzip.compress(words[:at] + b", " + inner + b" , " + words)) + " y"
            _, spans, _, oversized = secrets.scan(text)
            assert ("assign", 2, len(text) - 2) in spans and oversized >= 1


def raw_deflate(data):
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


@pytest.mark.parametrize(
    ("before", "run"),
    [
        ("http://h.com/a/", b64(SECRET.encode())), ("k-", b64(SECRET.encode())), ("a_bc_", b64(SECRET.encode())), ("p/q/", b64(b64(SECRET.encode()).encode())),
        ("x/yz-", b64(gzip.compress(SECRET.encode()))), ("http://u/", b64(zlib.compress(SECRET.encode() * 3))), ("run ", b64(SECRET.encode("utf-16-le"))),
        ("run ", b64(SECRET.encode("utf-16-be"))), ("-EncodedCommand/", b64(SECRET.encode("utf-16"))), ("", b64(raw_deflate(SECRET.encode() * 2))), ("a/b/", b64(raw_deflate(b64(SECRET.encode()).encode()))),
        ("", "\\U00000070" + SECRET[1:]), ("", "%u0070" + SECRET[1:]), ("q=a%20b&", "password+%3D+hunter22"), ("", quote(SECRET.encode("utf-16-le"))), ("é/", b64(("é " + SECRET).encode())),
    ],
)
def test_layers_behind_paths_and_of_other_codes(before, run):
    text = f"né {before}{run}, end"
    spans = [s for s in secrets.scan(text)[1] if s[0] == "assign"]
    start, end = 3 + len(before), 3 + len(before) + len(run.rstrip("="))
    assert spans and all(start <= a < b <= end + 2 for _, a, b in spans), (spans, start, end)
    assert max(b - a for _, a, b in spans) >= 0.6 * (end - start) - 8


def plainly_found(text):
    """Secrets in a text and its layers, by trying every decoder at every place of every run."""
    from urllib.parse import unquote_plus, unquote_to_bytes

    found, todo, seen = set(), [text], set()
    inflate = [gzip.decompress, zlib.decompress, bz2.decompress, lzma.decompress, lambda b: zlib.decompress(b, -15), lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b)]
    while todo:
        layer = todo.pop()
        if layer in seen:
            continue
        seen.add(layer)
        if isinstance(layer, bytes):
            todo.append(layer.decode("utf-8", "replace"))
            for code in ("utf-16-le", "utf-16-be"):
                if layer.count(0) * 3 > len(layer):
                    todo.append(layer.decode(code, "replace"))
            for unpack in inflate:
                try:
                    todo.append(unpack(layer))
                except Exception:
                    pass
            continue
        found.update((kind, layer[a:b]) for kind, a, b in plain_matches(layer))
        todo += [unquote_to_bytes(layer.encode()), unquote_plus(layer)] if "%" in layer else []
        if "\\" in layer:
            todo.append(re.sub(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|U([0-9a-fA-F]{8}))", lambda m: chr(min(int(m.group(m.lastindex), 16), 0x10FFFF)), layer))
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", layer):
            for k in {0, *(p.end() for p in re.finditer(r"[+/_-]", m.group()))}:
                run = m.group()[k:]
                if len(run) >= 16 and len(run) % 4 != 1:
                    todo.append(base64.urlsafe_b64decode((run + "=" * (-len(run) % 4)).replace("+", "-").replace("/", "_")))
    return found


def test_random_nestings_are_found_like_by_a_plain_unwrapper():
    rng = np.random.default_rng(11)
    wraps = [
        lambda t: quote(t, safe=""), lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: "".join(f"\\x{ord(c):02x}" for c in t), lambda t: "".join(f"\\U{ord(c):08x}" for c in t),
        lambda t: b64(t.encode()), lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="), lambda t: b64(t.encode("utf-16-le")), lambda t: b64(raw_deflate(t.encode())),
        *[lambda t, z=z: b64(z(t.encode())) for z in ZIPS], lambda t: "path/to-" + t, lambda t: "say " + t + " now",
    ]
    for _ in range(120):
        key = "".join(rng.choice(list("abcdefgh23456"), 14))
        text = f"token = {key}" if rng.random() < 0.8 else "nothing to see here at all"
        for k in rng.integers(0, len(wraps), int(rng.integers(1, 5))):
            text = wraps[k](text)
        text = f"x {text} y"
        _, spans, *_ = secrets.scan(text)
        wanted = {found for kind, found in plainly_found(text) if kind == "assign" and key in found}
        assert bool(wanted) == any(kind == "assign" for kind, _, _ in spans), text


@pytest.mark.parametrize("text", ["z" * 1_000_000, b64(np.random.default_rng(1).bytes(750_000)), "ab/" * 333_333, "%41+" * 250_000, b64(("x" * 400_000).encode("utf-16-le"))], ids=["one", "noise", "path", "form", "wide"])
def test_a_million_letters_take_seconds(text):
    began = time.process_time()
    assert secrets.scan(text)[0] == []
    assert time.process_time() - began < 20


def test_odd_rows_of_secrets(spark):
    long = "漢字 no spaces %".replace(" ", "") * 60_000
    rows = [(1, long), (1, long), (None, SECRET), (2, SECRET + " " + SECRET)]
    docs = docs_of(spark, rows).withColumnRenamed("lang", "spans").withColumnRenamed("source", "base")
    began = time.time()
    got = sorted((r["doc_id"] or 0, len(r["spans"])) for r in secrets.find_secrets(docs).collect())
    assert got == [(0, 1), (1, 0), (1, 0), (2, 2)] and time.time() - began < 60
    assert secrets.find_secrets(docs.limit(0)).count() == 0
    began = time.time()
    secrets.scan("a" * 1_000_000 + "%41")
    assert time.time() - began < 10


def test_secret_query_columns(spark, sf_dir):
    rows = secrets.find_secrets(docs_of(spark, [(1, None), (2, ""), (3, f"x {SECRET}"), (3, f"x {SECRET}")])).collect()
    assert [len(r["spans"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [0, 0, 1, 1]
    query = {r["doc_id"]: r for r in secrets.op2_secret_scan(spark, sf_dir).collect()}
    for r in query.values():
        base = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert len(base) >= r["n_assign"] + r["n_access"] + r["n_hex"]
    assert secrets.sha256("") in {r["base_sha256"] for r in query.values()}


# --- pieces


@pytest.fixture(scope="module")
def machine():
    return pieces.Transducer(pieces.read_model())


def test_answers_about_neighbours_stay_in_their_slots():
    asked = []
    table = pieces.Lately(lambda key: asked.append(key) or key % 3 == 0, bits=4)
    keys = np.array([5, 9, 5, 0, 9, 123_456_789_012])
    for _ in range(2):
        assert table.of(keys).tolist() == [False, True, False, True, True, True]
    assert sorted(asked[:4]) == [0, 5, 9, 123_456_789_012]
    many = np.arange(1000)
    assert table.of(many).tolist() == [k % 3 == 0 for k in range(1000)] == table.of(many).tolist() and len(table.slots) == 16
    assert table.of(keys[:0]).tolist() == []


def test_encoding_is_the_model_s_own(machine, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    extra = ["", " ", "  a", "a  ", "a\n\nb\tc", "日本語 漢字 🤣🤣 x", "\x00\x01", "    code(); // x\r\n", "A" * 500, "é ﬁ ½", "<s> </s> <0x0A>", "aaaa bbbb " * 50]
    for text in [*list(texts.values())[:60], *extra]:
        ids = machine.encode(text)
        assert ids.tolist() == model.encode(text)
        assert machine.decode(ids) == text == model.decode(ids.tolist())


def test_pieces_round_trip_in_spark(spark):
    rows = [(1, "a b\nc é"), (2, ""), (3, None), (4, "x" * 20000), (4, "x" * 20000), (None, "né")]
    encoded = pieces.encode_documents(docs_of(spark, rows))
    assert encoded.where("not round_trip").count() == 0
    back = sorted((r["doc_id"] or 0, r["text"]) for r in pieces.decode_documents(encoded).collect())
    assert back == sorted((i or 0, t or "") for i, t in rows)
    assert pieces.encode_documents(docs_of(spark, [])).count() == 0


def test_memory_is_bounded_and_right():
    asked = []
    recent = Recent(lambda keys: asked.extend(keys) or [k.upper().encode() for k in keys], 20 * (ENTRY + 2))
    for k in "abcdefghijklmnop" * 3:
        assert recent.of([k]) == {k: k.upper().encode()}
        assert len(recent.newer) + len(recent.older) <= 20
    assert recent.of(["a", "z" * 100, "a"]).keys() == {"a", "z" * 100} and "z" * 100 not in recent.newer


def field(number, value):
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(words, charsmap=b""):
    """A model file with these pieces (text: score)."""
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((w, s, 1) for w, s in words.items())]
    out = b"".join(field(1, field(1, t.encode()) + field(2, float(s)) + field(3, k)) for t, s, k in pieces_)
    return out + field(2, field(3, 1)) + field(3, field(2, charsmap) + field(3, 1) + field(4, 1) + field(5, 1))


def test_shortest_paths_of_unigram_models():
    """The weight of each path is that of the library's, whatever path it takes of equal ones."""
    import sentencepiece

    rng = np.random.default_rng(0)
    rules = pieces.parse_model(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()).charsmap
    for trial in range(6):
        words = sorted(set("abcd▁é") | {"".join(rng.choice(list("▁abcd"), int(rng.integers(2, 5)))) for _ in range(30)})
        data = unigram_model({w: -float(rng.integers(1, 4000)) / 100 for w in words}, rules if trial == 0 else b"")
        library, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Transducer(pieces.parse_model(data))
        texts = ["".join(rng.choice(list("abcd  xéﬁ"), int(rng.integers(0, 40)))) for _ in range(100)] + ["", " ", "a  b ", "x" * 70]
        weight = lambda ids: sum(library.get_score(int(i)) for i in ids)  # noqa: B023, E731
        for text, ids in zip(texts, own.encode_all(texts), strict=True):
            theirs = library.encode(text)
            assert weight(ids) == pytest.approx(weight(theirs), abs=1e-3) and own.decode(ids) == library.decode(ids.tolist())
            assert own.normalise(text).replace("▁", " ").strip() == library.normalize(text).replace("▁", " ").strip()


def test_models_that_cannot_be_compiled_are_refused():
    data = unigram_model({"a": -1.0})
    for bad in (data + field(2, field(3, 3)), data + field(2, field(3, 1) + field(24, 1)), data + field(1, field(1, b"own") + field(3, 4))):
        with pytest.raises(ValueError, match="cannot be compiled|can be compiled"):
            pieces.parse_model(bad)


def test_texts_without_a_cut(machine):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    rng = np.random.default_rng(1)
    for text in ("a" * 3000, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 2000)), "漢字" * 500, "\x00a\x00"):
        assert machine.encode(text).tolist() == model.encode(text)


# --- toxicity and language


def test_logistic_fit_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 3))
    y = (x[:, 0] > 0.5).astype(float)
    w, mean, deviation = toxicity.fit_logistic(x, y)
    score = 1 / (1 + np.exp(-(((x - mean) / deviation) @ w[:-1] + w[-1])))
    assert ((score > 0.5) == (y > 0)).mean() > 0.95


def plain_kneser_ney(words, column):
    """log P(letter | letters before) of one class by the formula, over dicts; words: (toxic, ordinary) counts."""
    grams = {}
    for word, counts in words.items():
        marked = toxicity.START + word + toxicity.END
        for end in range(2, len(marked) + 1):
            for n in range(1, min(toxicity.ORDER, end) + 1):
                of = grams.setdefault(marked[end - n : end], [0, 0])
                of[0] += counts[0]
                of[1] += counts[1]
    before = {}
    for g, counts in grams.items():
        of = before.setdefault(g[1:], [0, 0])
        of[0] += counts[0] > 0
        of[1] += counts[1] > 0

    def use(g):
        counts = grams[g] if len(g) == toxicity.ORDER or g[0] == toxicity.START else before.get(g, [0, 0])
        return sum(counts) if len(g) <= toxicity.SHARED else counts[column]

    followers = {}
    for g in grams:
        followers.setdefault((len(g), g[:-1]), []).append(use(g))
    letters = sum(len(g) == 1 for g in grams)

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / letters
        uses = followers.get((len(g), g[:-1]), [0])
        total = sum(uses)
        if not total:
            return lower
        own = use(g) if g in grams else 0
        return max(own - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * sum(u > 0 for u in uses) / total * lower

    def log_likelihood(word):
        marked = toxicity.START + word + toxicity.END
        return sum(np.log(p(marked[max(0, end - toxicity.ORDER) : end])) for end in range(2, len(marked) + 1))

    return log_likelihood


def test_ratios_are_those_of_plain_kneser_ney_models(spark):
    rng = np.random.default_rng(2)
    words = {"".join(rng.choice(list("abcd"), int(rng.integers(1, 9)))): (int(rng.integers(0, 4)), int(rng.integers(0, 4))) for _ in range(60)}
    words = {w: c for w, c in words.items() if sum(c)}
    counts = spark.createDataFrame([(w, *c) for w, c in words.items()], "word string, t long, o long")
    grams = toxicity.keyed_ngrams(toxicity.ngram_counts(counts)).cache()
    ratios = toxicity.Ratios(*toxicity.ratio_tables(lambda k: toxicity.Order(grams.where(F.col("n") == k).toArrow())))
    asked = [*words, "abcdabcd", "dd", "a", "xyz", "abxcd"]
    toxic, ordinary = plain_kneser_ney(words, 0), plain_kneser_ney(words, 1)
    wanted = [toxic(w) - ordinary(w) for w in asked if set(w) <= set("abcd")]
    assert ratios.words([w for w in asked if set(w) <= set("abcd")]) == pytest.approx(wanted, abs=1e-4)
    assert np.isfinite(ratios.words(asked)).all()
    one = ratios.words(["ab", "cd"])
    assert ratios.features(["", None, " \n", "ab cd"])[:3].tolist() == [[0.0] * toxicity.FEATURES] * 3
    assert ratios.features(["ab cd"])[0][0] == pytest.approx(one.mean())


def test_words_are_counted_whole(spark):
    long = " ".join(f"w{k % 50}" for k in range(60_000)) + " w" + "v" * 50
    rows = spark.createDataFrame([("B b a", 1), ("a", 0), (long, 0), ("x" * 100, 1)], "text string, toxic int")
    got = {r["word"]: (r["t"], r["o"]) for r in toxicity.word_counts(rows).collect()}
    assert got["b"] == (2, 0) and got["a"] == (1, 1) and got["x" * 40] == (2, 0) and got["x" * 20] == (1, 0)
    assert sum(o for w, (_, o) in got.items() if w[0] == "w") == 60_001 and all(got[f"w{k}"] == (0, 1200) for k in range(50))


def test_a_sample_with_too_many_letters_loses_whole_rows(spark):
    rows = spark.createDataFrame([(k, f"t{k} " + "x" * 96, k % 2, k % 5 == 0) for k in range(2000)], "id long, text string, toxic int, fits boolean")
    assert toxicity.thinned(rows).count() == 2000
    few = toxicity.thinned(rows, 40_000).collect()
    assert 300 < sum(not r["fits"] for r in few) < 500 and sum(r["fits"] for r in few) == 400 and all(len(r["text"]) > 96 for r in few)


def test_long_texts_are_scored_as_a_whole(spark):
    """What decides a text may stand anywhere in it: the ratios of a long one follow from those of its words."""
    model = toxicity.Ratios(*(np.zeros(0, t) for t in (np.uint64, np.float32, np.uint64, np.float32)))
    model.words = lambda words: np.array([9.0 if w == "bad" else -1.0 for w in words])
    for at in (0, 70_000, 199_999):
        words = ["ok"] * 200_000
        words[at] = "bad"
        x = model.features([" ".join(words)])[0]
        assert x[0] == pytest.approx((9.0 - 199_999) / 200_000) and x[1] == pytest.approx((9.0 - 3) / 4)


def test_toxicity_finds_held_out_insults(spark):
    rng = np.random.default_rng(3)
    plain, bad = [f"w{k}" for k in "abcdefghij"], ["zorgle", "blighter"]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, 30))
        if i % 4 == 0:
            words[3] = words[20] = bad[i % 8 // 4]
        rows.append((i, " ".join(words)))
        labels.append((i, i % 4 == 0))
    docs = docs_of(spark, [*rows, (1000, None), (1001, ""), (None, "wa wb"), (1002, "wa " * 5000), (3, rows[3][1])])
    label_rows = spark.createDataFrame([(i, 1, int(t)) for i, t in labels] + [(5000, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, label_rows).collect()
    assert len(got) == 405
    held = [(r["predicted"], r["doc_id"] % 4 == 0) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert held and all(p == t for p, t in held)
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.drop_toxic(docs, label_rows)
    assert kept.columns == docs.columns and kept.where("doc_id < 400").count() == 301
    nothing = toxicity.score_toxicity(docs, label_rows.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), label_rows).count() == 0
    again = {(r["doc_id"], r["score"]) for r in got}
    odd = docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "toxic").withColumnRenamed("extra", "id").repartition(3)
    assert {(r["doc_id"], r["score"]) for r in toxicity.score_toxicity(odd, label_rows.unionByName(label_rows)).collect()} == again
    assert toxicity.drop_toxic(odd, label_rows).columns == odd.columns


def test_language_features_are_those_of_single_words():
    words = ["a", "né", "word", "x" * 40]
    together = [np.split(buckets, starts[1:]) for buckets, starts in language_id.windows(words)]
    for k, word in enumerate(words):
        alone = [buckets for buckets, _ in language_id.windows([word])]
        assert all(np.array_equal(a, t[k]) for a, t in zip(alone, together, strict=True))
        marked = len(word) + 2
        assert sum((b < language_id.BUCKETS).sum() for b in alone) == 1 + sum(max(0, marked - n + 1) for n in language_id.NGRAMS)
    model = language_id.Classifier(["x", "y"], np.random.default_rng(0).normal(0, 1, (language_id.BUCKETS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    texts = ["one two one", "two", "z" * 300_000, "w " * 200_000]
    rows = {t: model.word_rows([w for part in words_module.word_lists(t) for w in part]).sum(0) for t in texts}
    assert model.means(texts) == pytest.approx(np.array([r[:-1] / r[-1] for r in rows.values()]), rel=1e-5)


def plain_train(cut, labels, n, epochs, seed=7):
    """Stochastic gradient descent for averaged embeddings and a softmax, one text and one number at a time."""
    dim, batch = language_id.DIM, language_id.BATCH
    xs = [[b for w in s.split(" ") for buckets, _ in language_id.windows([w]) for b in buckets.tolist() if b < language_id.BUCKETS] for s in cut]
    rng = np.random.default_rng(seed)
    rows, layer, offset = rng.normal(0, 1 / dim, (language_id.BUCKETS, dim)), rng.normal(0, 1 / dim, (dim, n)), [0.0] * n
    weight = [len(labels) / (n * max(1, labels.count(k))) for k in range(n)]
    steps, step = epochs * (len(xs) // batch + 1), 0
    for _ in range(epochs):
        order = rng.permutation(len(xs)).tolist()
        for start in range(0, len(order), batch):
            at, rate = order[start : start + batch], language_id.RATE * (1 - step / steps)
            downs, layers, offsets = [], np.zeros((dim, n)), [0.0] * n
            for k in at:
                mean = [sum(rows[b][j] for b in xs[k]) / len(xs[k]) for j in range(dim)]
                z = [sum(mean[j] * layer[j][c] for j in range(dim)) + offset[c] for c in range(n)]
                e = [np.exp(v - max(z)) for v in z]
                error = [(v / sum(e) - (c == labels[k])) * weight[labels[k]] / len(at) for c, v in enumerate(e)]
                downs.append((k, [sum(error[c] * layer[j][c] for c in range(n)) / len(xs[k]) for j in range(dim)]))
                for c in range(n):
                    offsets[c] += error[c]
                    for j in range(dim):
                        layers[j][c] += mean[j] * error[c]
            for j in range(dim):
                for c in range(n):
                    layer[j][c] -= 0.02 * rate * layers[j][c]
            offset = [o - 0.02 * rate * g for o, g in zip(offset, offsets, strict=True)]
            for k, down in downs:
                for b in xs[k]:
                    for j in range(dim):
                        rows[b][j] -= rate * down[j]
            step += 1
    return rows, layer, np.array(offset)


def test_training_is_plain_gradient_descent(monkeypatch):
    for name, value in (("STEPS", 1), ("STEPS_EACH", 0), ("EPOCHS", 3), ("BATCH", 4)):
        monkeypatch.setattr(language_id, name, value)
    cut = ["the cat sat", "the dog", "der hund saß", "die katze", "le chat", "le chien est", "the the the", "x"]
    labels = [0, 0, 1, 1, 2, 2, 0, 2]
    got, wanted = language_id.train(cut, labels, 3), plain_train(cut, labels, 3, 3)
    for a, b in zip(got, wanted, strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-12)
    assert not np.allclose(got[1], np.random.default_rng(7).normal(0, 1, got[1].shape))


def test_languages_of_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.learn(docs)
    got = language_id.find_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.95
    odd = docs_of(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "the of and " * 3000), (4, "the of and " * 3000), (None, "und die der"), (5, "漢" * 100_000)])
    found = {r["doc_id"]: r for r in language_id.find_languages(odd.withColumnRenamed("source", "score").withColumnRenamed("extra", "held_out"), model).collect()}
    assert [found[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and found[4]["lang_pred"] == "en" and len(found) == 6
    empty = language_id.find_languages(docs.limit(0))
    assert empty.count() == 0


def test_language_sample_is_bounded_for_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 50)
    rows = [(None, f"text number w{k}", "en" if k % 2 else "de", "s", 0) for k in range(1000)] + [(None, "the same", "en", "s", 0)] * 500 + [(None, "123", "fr", "s", 0)]
    sample = language_id.take_sample(spark.createDataFrame(rows, SCHEMA), Scratch(spark)).collect()
    assert 20 < len(sample) < 200 and sum(r["text"] == "the same" for r in sample) <= 1 and {r["lang"] for r in sample} == {"de", "en"}


def test_any_number_of_languages_is_learned(spark):
    """More languages than the former bound of 256, one of them with a single text; a plain version of the scoring."""
    rng = np.random.default_rng(3)
    letters = [chr(0x4E00 + k) for k in range(900)]
    rows = [(1000 * k + n, " ".join("".join(rng.choice(letters[3 * k : 3 * k + 3], 3)) for _ in range(30)), f"l{k:03d}", "s", 0) for k in range(299) for n in range(8)]
    rare = next(k for k in range(500_000, 500_100) if zlib.crc32(str(k).encode()) % 4 == 0)
    rows.append((rare, "zzz qqq " * 20, "rare", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.learn(docs)
    assert len(model.languages) == 300 and "rare" in model.languages and model.layer is not None
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in language_id.find_languages(docs, model).collect()}
    wanted = {r[0]: r[2] for r in rows}
    assert np.mean([got[k][0] == v for k, v in wanted.items() if got[k][2]]) >= 0.9 and got[rare][0] == "rare"
    for doc_id, text, *_ in rows[:6]:
        z, n = np.zeros(model.rows.shape[1]), 0
        for word in text.split():
            for buckets, _ in language_id.windows([word]):
                for b in buckets[buckets < language_id.BUCKETS]:
                    z, n = z + model.rows[b], n + 1
        p = model.softmax((z / n @ model.layer + model.offset)[None])[0]
        assert model.languages[int(p.argmax())] == got[doc_id][0] and p.max() == pytest.approx(got[doc_id][1], rel=1e-4)


def test_spans_are_json_like(spark):
    r = secrets.find_secrets(docs_of(spark, [(1, f"x {SECRET}")])).first()
    assert json.dumps([s.asDict() for s in r["spans"]])
