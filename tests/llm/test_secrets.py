import hashlib
import random
import re
import string
import time

import public_tokenizers
import pyarrow.parquet as pq

from foldspark.llm import secrets

PATH = public_tokenizers.path(secrets.VOCABULARY)


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(2)
    pieces = ["password", "PassWd", "api_key", "apikey", "ſecret", "toKen", ":", "=", " ", "'", '"', "abc", "abcdef", "AKIA", "AKIA" + "Z9" * 9, "0f" * 13, "é", "-", ".", "a1b2c3d4", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14)))
        assert [s for s in secrets.find_spans(text, PATH) if s[1] < 3] == brute(text)


def test_token_efficiency():
    rng = random.Random(3)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    assert [k for _, k, _ in secrets.find_spans(f"see {key} there", PATH)] == [3]
    for plain in ("internationalization-of-everything", hashlib.md5(b"x").hexdigest(), "123e4567-e89b-12d3-a456-426614174000", "thisisalongwordwithoutanydigits", "20240101-2024-0202-1111"):
        assert not [s for s in secrets.find_spans(plain, PATH) if s[1] == 3]


def test_random_strings_by_alphabet_and_length():
    """Nine tenths are found of letters and digits from 12 characters on, with separators or of letters alone from 16 on; lower case, whose random strings come nearest to words, from 24 on."""
    rng = random.Random(5)
    alphabets = {"letters": string.ascii_letters, "alnum": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "url": string.ascii_letters + string.digits + "-_", "base32": string.ascii_uppercase + "234567", "upper": string.ascii_uppercase, "lower": string.ascii_lowercase}
    for name, alphabet in alphabets.items():
        for n in {"lower": (24, 40), "upper": (20, 40), "alnum": (12, 16, 20, 40)}.get(name, (16, 20, 40)):
            found = sum(secrets.is_random("".join(rng.choice(alphabet) for _ in range(n)), PATH) for _ in range(400))
            assert found >= 0.9 * 400, (name, n, found)


def test_names_numbers_and_words_are_left_alone():
    for plain in (
        "img_20240102_123456_HDR_portrait_v2", "20240102T123456Z", "a/b/c/d/e/f/g/h/i/j/k/l", "2024-01-02T12-30-59", "getElementsByClassName", "internationalization", "MAX_BUFFER_SIZE_DEFAULT",
        "github/blob/" + hashlib.sha1(b"x").hexdigest() + "/src/main", "objects/123e4567-e89b-12d3-a456-426614174000/meta", "=" * 80, "-" * 40 + "+" + "-" * 40, "1234567890" * 4,
    ):
        assert not [s for s in secrets.find_spans(plain, PATH) if s[1] == 3], plain
    assert secrets.is_random("downloads/archive/x8KqPz3mWvT1bYrL9sJd/readme", PATH)


def test_words_of_documents_are_seldom_reported():
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()]
    words = {m[0] for t in texts for m in re.finditer("[A-Za-z0-9+/_=-]{12,}", t)}
    found = {w for w in words if w.isalpha() and secrets.is_random(w, PATH)}
    assert len(words) > 20_000 and len(found) <= len(words) / 2000, found


def test_long_runs_take_time_in_proportion():
    began = time.process_time()
    assert not secrets.is_random("a" * 2_000_000, PATH)
    assert time.process_time() - began < 10


def test_redaction():
    text = "a password: hunter2hunter AKIA" + "A" * 16 + " b"
    assert secrets.redact(text, PATH) == "a [SECRET] [SECRET] b"
    assert secrets.redact("clean text", PATH) == "clean text"
    assert secrets.redact("token=" + "0f" * 20 + "!", PATH) == "[SECRET]!"


def test_rows(spark):
    long = "word " * 40_000 + "secret=abcdef123"
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, long, "c"), (3, long, "c"), (None, "x", "c")], "doc_id long, text string, spans string")
    found = secrets.scan(docs).orderBy("doc_id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_assign, r.base_sha256 == empty) for r in found] == [(None, 0, True), (1, 0, True), (2, 0, True), (3, 1, False), (3, 1, False)]
    assert found[-1].spans == f"assign:200000:{len(long)}"
    kept = secrets.redact_documents(docs.withColumnRenamed("spans", "n_chars").selectExpr("doc_id", "text", "cast(7 as long) as n_chars")).orderBy("doc_id").collect()
    assert kept[-1].text.endswith("word [SECRET]") and kept[-1].n_chars == 200_008 and kept[1].text is None and kept[0].n_chars == 7
    assert secrets.scan(docs.limit(0)).count() == 0


def test_a_batch_is_redacted_some_rows_at_a_time(spark):
    """A worker does not hold all texts of a batch of 10,000 as Python strings."""
    import pyarrow as pa

    class Docs:
        columns, schema = ["text"], None

        def mapInArrow(self, rows, _):
            return rows

    batch = pa.RecordBatch.from_arrays([pa.array([None, "token = abcdef123", *["word " * 3] * 10_000])], names=["text"])
    out = list(secrets.redact_documents(Docs())(iter([batch])))
    assert max(b.num_rows for b in out) <= 1000
    assert [t for b in out for t in b.column(0).to_pylist()] == [t if t is None else secrets.redact(t, public_tokenizers.path(secrets.VOCABULARY)) for t in batch.column(0).to_pylist()]
