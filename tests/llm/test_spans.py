import hashlib
import random
import re

import pytest

from colprobe.llm import pii, secrets

ASSIGN = re.compile(
    r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def secret_base(text):
    found = [("assign", 0, m) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", 1, m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", 2, m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{m.start()}:{m.end()}" for k, _, m in sorted(found, key=lambda f: (f[2].start(), f[1]))]


def personal_base(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            lambda m: all(int(p) <= 255 for p in m[0].split(".")),
        ),
        "card": (
            r"[0-9]([\x20-]?[0-9])+",
            lambda m: 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m)),
        ),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, (pattern, valid) in rules.items()
        for m in re.finditer(pattern, text)
        if valid(m)
    ]


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.mark.parametrize("alphabet", ["ab1@.-+ ", "0123.", "0 -4+().", "a.@-_%+1é", "19.- +@()x", "0."])
def test_parsers_agree_with_patterns(alphabet):
    rng, anchors = random.Random(alphabet), pii.automaton()
    for _ in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        base = [s for s in pii.find(text, anchors) if s[0] in pii.BASE]
        assert [f"{k}:{s}:{e}" for k, s, e in base] == personal_base(text), text


def test_cards_and_addresses_in_long_digits():
    anchors = pii.automaton()
    for text in (
        "4111 1111-1111 1111",
        "1.2.3.4.5.6.7.8",
        "300.1.1.1.2.2.2.2",
        "0000000000000000000000.1.1.1",
        "4111111111111111.10.2.3",
        "10.0.0.1-4111111111111111",
        "+49 (30) 123.456-78 9+1 2",
        "4242424242424242 " * 3,
    ):
        base = [s for s in pii.find(text, anchors) if s[0] in pii.BASE]
        assert [f"{k}:{s}:{e}" for k, s, e in base] == personal_base(text), text


def test_added_kinds():
    anchors = pii.automaton()
    assert ("login", 7, 27) in pii.find("http://user:pw@host.example/x", anchors)
    assert ("iban", 6, 28) in pii.find("IBAN: DE89370400440532013000 ok", anchors)
    assert not pii.find("IBAN: DE89370400440532013001", anchors)


def test_personal_rows(odd_docs, no_docs, make_docs):
    assert pii.personal_spans(odd_docs).count() == odd_docs.count()
    assert pii.personal_spans(no_docs).count() == 0
    texts = {1: "é a@b.co x", 2: None, 3: "call +1 555 123 4567 or 10.0.0.1"}
    for r in pii.personal_spans(make_docs(list(texts.items()))).collect():
        base = personal_base(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len(base)


def test_masking(odd_docs, no_docs, make_docs):
    masked = pii.masked(make_docs([(1, "mail a@b.co, ip 10.0.0.1"), (2, None)])).orderBy("doc_id").collect()
    assert masked[0]["text"] == "mail [EMAIL], ip [IP]"
    assert masked[0]["n_chars"] == len(masked[0]["text"]) and masked[1]["text"] is None
    assert pii.masked(odd_docs).schema == odd_docs.schema
    assert pii.masked(no_docs).count() == 0


def test_secrets_agree_with_patterns(spark, make_docs):
    rng = random.Random(11)
    words = [
        "token", "Secret", "api_key", "APIKEY", "passwd", "=", ":", '"', "'", " ", "  ", "abcdef",
        "ab", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "é", "\n", "==", "-----BEGIN ",
    ]
    texts = {n: "".join(rng.choices(words, k=rng.randint(0, 25))) for n in range(400)}
    for r in secrets.secret_spans(make_docs(list(texts.items()))).collect():
        base = secret_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), texts[r["doc_id"]]
        assert r["n_assign"] == sum(s.startswith("assign") for s in base)
        assert [s for s in r["spans"].split(",") if s and not s.startswith("pem")] == base


def test_added_secret_kind(make_docs):
    text = "x -----BEGIN RSA PRIVATE KEY----- token=abcdefgh"
    row = secrets.secret_spans(make_docs([(1, text)])).first()
    assert row["spans"] == "pem:2:33,assign:34:48" and row["n_assign"] == 1
    assert row["base_sha256"] == hashlib.sha256(b"assign:34:48").hexdigest()


def test_ledger_scans_only_what_is_new(spark, make_docs, odd_docs, no_docs, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = make_docs([(1, "token=abcdefgh"), (2, "nothing"), (3, "token=abcdefgh")])
    secrets.update_ledger(first, rule_version=1)
    assert secrets.secret_spans(first).count() == 3
    spark.createDataFrame([], secrets.LEDGER).write.parquet(ledger)

    def scanned():
        return spark.read.parquet(ledger).where("kind IS NULL").count()

    found = secrets.secret_spans(first, ledger).collect()
    assert scanned() == 2 and sum(r["n_assign"] for r in found) == 2
    more = make_docs([(1, "token=abcdefgh"), (4, "secret: 12345678")])
    found = {r["doc_id"]: r["n_assign"] for r in secrets.secret_spans(more, ledger).collect()}
    assert scanned() == 3 and found == {1: 1, 4: 1}
    secrets.secret_spans(more, ledger, rule_version=2).collect()
    assert scanned() == 5  # new rules look at everything again
    assert secrets.secret_spans(odd_docs).count() == odd_docs.count()
    assert secrets.secret_spans(no_docs).count() == 0


def test_login_of_any_length(make_docs):
    """The password is searched to its end, also in a very long text of many schemes."""
    long = "https://user:" + "p#" * 50_000 + "@host.example"
    many = "https://" * 20_000 + " https://a/b@c https://u:p@q@r.s"
    docs = make_docs([(1, f"see {long} there"), (2, many), (3, "ftp://u:p w@h.example")])
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_spans(docs).collect()}
    assert f"login:{4 + len('https://')}:{4 + len(long)}" in spans[1].split(",")
    assert "login" not in spans[2] and "login" not in spans[3]
    masked = {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()}
    assert "p#" not in masked[1]


def test_a_new_ledger_folder_is_made(make_docs, tmp_path):
    docs = make_docs([(1, "password=hunter22"), (2, None)])
    folder = str(tmp_path / "new" / "ledger")
    first = sorted(map(tuple, secrets.secret_spans(docs, folder).collect()))
    assert sorted(map(tuple, secrets.secret_spans(docs, folder).collect())) == first
    assert [r[1] for r in first] == [1, 0]
