import hashlib
import re

from stackmeter.llm import pii

from .fixtures import awkward, frame, plain

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 // 10 + int(c) * 2 % 10 for i, c in enumerate(reversed(s))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def named(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


CASES = [
    "a@b.c@d.e a@b.c_d@e.f x@y .@-.- é@b.co 😀 me.you+z@ho-st.example.org.", "1.2.3.4.5 999.1.1.1 01.002.0003.255 1.2.3 10.0.0.256.1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 0000 0000 0000 00",
    "+1 (743) 555-3824 +1+2 +123 +44.20.7946.0958- (+1) +1 2345678901234567", "5 5 5", "1" * 60_000, "a" * 60_000 + "@", "1-" * 40_000, "+1" + " 2" * 30_000, "x.y@" * 20_000, "😀" * 500 + "a@b.cd", "1.1.1.1" + ".1" * 20_000,
]


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(r[0], r[1]) for r in awkward()]
    by_id = {}
    for r in pii.report(plain(spark, rows)).collect():
        by_id.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        want = brute(text)
        digest = hashlib.sha256(named(want).encode()).hexdigest()
        assert digest in {r.base_sha256 for r in by_id[i]}, (i, (text or "")[:60])
        row = next(r for r in by_id[i] if r.base_sha256 == digest)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert set(filter(None, named(want).split(","))) <= set(row.spans.split(","))


def test_trees_add_spans_and_spare_others(spark):
    texts = ["write to jane.doe [at] example [dot] org soon", "call (743) 555-3824 now", "order 743-555-3824 of part", "card 4111.1111.1111.1111 please", "serial 1234.5678.9012.3456"]
    got = [r.spans for r in sorted(pii.report(plain(spark, list(enumerate(texts)))).collect(), key=lambda r: r.doc_id)]
    assert got == ["email:9:40", "phone:5:19", "", "card:5:24", ""]


def test_held_out_precision():
    x, y = pii.examples(2000, seed=99)
    trees, limits = pii.model()
    chosen = [good for row, good in zip(x, y, strict=True) if sum(pii._leaf(t, row) for t in trees) >= limits[int(row[0])]]
    assert len(chosen) > 300 and sum(chosen) / len(chosen) > 0.93


def test_plan_has_no_python(spark):
    plan = pii.report(frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert pii.report(frame(spark, [])).count() == 0


def test_redaction(spark):
    rows = pii.redact(plain(spark, [(1, "mail a@b.cd or 1.2.3.4!"), (2, None)])).collect()
    assert {r.doc_id: r.text for r in rows} == {1: "mail <email> or <ip>!", 2: None}


#: Texts written by hand, not by the grammar that the trees learn from: (text, personal data beyond the base spans).
PLANTED = [
    ("Reach Anna under anna.berg [at] posteo [dot] de before noon.", ["anna.berg [at] posteo [dot] de"]),
    ("bitte an k_lehmann(at)uni-koeln(dot)de senden", ["k_lehmann(at)uni-koeln(dot)de"]),
    ("Escribe a m.lopez {at} correo {dot} es hoy", ["m.lopez {at} correo {dot} es"]),
    ("webmaster[at]example.org answers mail", ["webmaster[at]example.org"]),
    ("The host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 did not answer", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
    ("server fe80:0:0:0:1ff:fe23:4567:890a is down", ["fe80:0:0:0:1ff:fe23:4567:890a"]),
    ("Paid with card 5500.0000.0000.0004 yesterday", ["5500.0000.0000.0004"]),
    ("my visa is 4012_8888_8888_1881, thanks", ["4012_8888_8888_1881"]),
    ("Tel. (212) 736-5000, ask for Lou", ["(212) 736-5000"]),
    ("call me: 415-555-0132 tonight", ["415-555-0132"]),
    ("mobile 617 253 1000 or the desk", ["617 253 1000"]),
    ("von Paris 0049 30 901820 waehlen", ["0049 30 901820"]),
    ("contact 0033 1 42 68 53 00 for tickets", ["0033 1 42 68 53 00"]),
    ("He left 303.555.0188 on the note", ["303.555.0188"]),
    ("invoice 743-555-3824 was paid", []),
    ("serial 1234.5678.9012.3456 on the back", []),
    ("order no 212 736 5000 shipped", []),
    ("ref 0049 30 901820 closed", []),
    ("part 617-253-1000 is out of stock", []),
    ("version 4012_8888_8888_1882 of the build", []),
    ("the sum 123-456-7890 is wrong, code 000-000-0000", []),
    ("meet at 10 (at) the dot on the map", []),
    ("build 00:11:22:33:44:55:66:77 passed", []),
    ("pages 100-200-3000 and 12 34 56", []),
]


def test_added_spans_on_texts_of_another_hand(spark):
    got = {r.doc_id: r.spans for r in pii.report(plain(spark, [(i, t) for i, (t, _) in enumerate(PLANTED)])).collect()}
    wanted = found = right = 0
    for i, (text, planted) in enumerate(PLANTED):
        base = {(a, e) for a, _, e in brute(text)}
        added = [tuple(map(int, s.split(":")[1:])) for s in filter(None, got[i].split(","))]
        added = [text[a:e] for a, e in added if (a, e) not in base]
        wanted, found, right = wanted + len(planted), found + len(added), right + len(set(added) & set(planted))
    print("recall", right / wanted, "precision", right / found)
    assert right / wanted >= 0.8 and right / found >= 0.8


def test_folds_over_many_spans(spark):
    text = " ".join(f"call (743) 555-{i:04d} or a{i}@b.cd" for i in range(9000))
    row = pii.report(plain(spark, [(1, text)])).collect()[0]
    want = brute(text)
    assert row.n_email == 9000 and row.base_sha256 == hashlib.sha256(named(want).encode()).hexdigest()
    phones = [(m.start(), 3, m.end()) for m in re.finditer(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", text)]
    assert row.spans == named(sorted(want + phones))
    assert pii.redact(plain(spark, [(1, text)])).collect()[0].text == " ".join(["call <phone> or <email>"] * 9000)
