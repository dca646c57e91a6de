import datetime
import re
import time

import pytest
from wavemill.llm import pii, queries

KEY = b"test key"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 73049])
def test_feistel_is_a_permutation(size):
    f = pii.Feistel(KEY, "x", size)
    n = min(size, 2000)
    out = [f.apply(k) for k in range(n)]
    assert len(set(out)) == n and all(0 <= y < size for y in out)
    assert [f.apply(y, back=True) for y in out] == list(range(n))


CASES = [
    ("mail bob.42@mail8.example.com now", "email"), ("card 4111111111111111 end", "card"), ("4111-1111-1111-1111", "card"), ("3782 822463 10005", "card"),
    ("+1 (988) 555-2485", "phone"), ("(212) 555-0187 x", "phone"), ("+49 30 1234567", "phone"), ("from 70.123.182.155 to", "ip"), ("born 1984-02-29.", "date"),
    ("on 31.12.1999", "date"), ("am 1.2.1984 um", "date"), ("on 1/2/2001.", "date"), ("le 25/12/2001", "date"), ("March 05, 1999", "date"), ("Bob.X@Mail8.Example.COM", "email"), ("+1 (123) 055-2485", "phone"), ("+44 020 7946 0018", "phone"), ("on 12/25/2001 ok", "date"), ("July 4, 1976", "date"), ("ssn 123-45-6789", "ssn"), ("IBAN DE89 3704 0044 0532 0130 00.", "iban"), ("GB82WEST12345698765432", "iban"),
]


@pytest.mark.parametrize("text,kind", CASES)
def test_kinds_keep_their_format_and_come_back(text, kind):
    new, spans = pii.pseudonymise(text, pii.Pseudonyms(KEY))
    assert [s[0] for s in spans] == [kind] and new != text
    _, a, b = spans[0]
    assert new[:a] == text[:a] and new.endswith(text[b:])
    again, spans = pii.pseudonymise(new, pii.Pseudonyms(KEY))
    assert [s[0] for s in spans] == [kind]  # valid again
    assert pii.pseudonymise(new, pii.Pseudonyms(KEY, back=True))[0] == text
    form = lambda t: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "0", t)))
    assert form(new) == form(text) or text[0] in "JM" or kind == "ip"  # month names and address parts differ in length
    assert pii.pseudonymise(text, pii.Pseudonyms(b"other"))[0] != new


@pytest.mark.parametrize("text", ["4111111111111112", "1984-02-30", "300.1.2.3", "000-12-3456", "version 4.0. 3.", "DE88 3704 0044 0532 0130 00", "AKIA1234 x12345678901234567", "", "plain words", "a @ b", "1.2.3"])
def test_invalid_values_stay(text):
    assert pii.pseudonymise(text, pii.Pseudonyms(KEY)) == (text, [])


def test_one_day_in_two_notations_stays_one_day():
    names = pii.Pseudonyms(KEY)
    iso, local, words = (pii.pseudonymise(t, names)[0] for t in ("1984-05-06", "06.05.1984", "May 6, 1984"))
    day = datetime.date.fromisoformat(iso)
    assert local == day.strftime("%d.%m.%Y") and words == f"{day:%B} {day.day}, {day.year}"


def test_linked_across_documents(spark, odd, nothing):
    rows = [(1, "call +1 (988) 555-2485 or 70.1.2.3"), (2, "it was 70.1.2.3, 70.1.2.4"), (3, None), (4, "")]
    got = {r.doc_id: r for r in pii.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    addresses = [re.findall(r"\d+\.\d+\.\d+\.\d+", got[k].text) for k in (1, 2)]
    assert addresses[0][0] == addresses[1][0] != addresses[1][1]
    assert (got[1].n_phone, got[1].n_ip, got[2].n_ip, got[3].text, got[4].pii_spans) == (1, 1, 2, None, "")
    assert pii.replace_personal_data(nothing, KEY).count() == 0
    texts = sorted((r.doc_id, r.text) for r in pii.replace_personal_data(odd, KEY).collect())
    assert [t for t in texts if t[0] != 22] == [t for t in sorted((r.doc_id, r.text) for r in odd.collect()) if t[0] != 22]


def _walk(text, at, form):
    """End of ``form`` at a place: 0 stands for a digit, everything else for itself; -1 if it is not there."""
    if len(text) - at < len(form) or any((not "0" <= c <= "9") if f == "0" else c != f for c, f in zip(text[at : at + len(form)], form)):
        return -1
    return at + len(form)


def _sum_is_right(digits):
    doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(digits[::-1])]
    return sum(sum(map(int, str(x))) for x in doubled) % 10 == 0 and len(set(digits)) > 1


def _found(text):
    """Mail and IPv4 addresses, card numbers and phone numbers of one usual form, found by walking over the characters."""
    out, inside = [], lambda c: c.isascii() and (c.isalnum() or c in "._%+-")
    for at, c in enumerate(text):
        before = text[at - 1] if at else " "
        if c == "@":
            a = at
            while a and inside(text[a - 1]):
                a -= 1
            b = at + 1
            while b < len(text) and text[b].isascii() and (text[b].isalnum() or text[b] in ".-"):
                b += 1
            domain = text[at + 1 : b].rstrip(".-")
            if at > a and "." in domain and domain.rsplit(".", 1)[1].isalpha():
                out.append(("email", a, at + 1 + len(domain)))
        if before.isalnum() or before in "_-":
            continue
        for form in ("0000-0000-0000-0000", "0000 0000 0000 0000", "0" * 16):
            end = _walk(text, at, form)
            if end > 0 and not (text[end : end + 1].isalnum() or text[end : end + 1] in ("-", "_")) and _sum_is_right("".join(x for x in text[at:end] if x.isdigit())):
                out.append(("card", at, end))
        end = _walk(text, at, "+0 (000) 000-0000")
        if end > 0 and not text[end : end + 1].isalnum():
            out.append(("phone", at, end))
        if c.isdigit() and before != ".":
            b = at
            while b < len(text) and (text[b].isdigit() or text[b] == "."):
                b += 1
            run = text[at:b].rstrip(".")
            parts = run.split(".")
            if len(parts) == 4 and all(p and int(p) < 256 and str(int(p)) == p for p in parts) and not text[at + len(run) : at + len(run) + 1].isalnum():
                out.append(("ip", at, at + len(run)))
    return out


def test_query_finds_what_a_walk_over_the_characters_finds(spark, sf):
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op1_pii_pseudonyms(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(old) and sum(r.n_email + r.n_phone + r.n_card + r.n_ip for r in got) > 10
    images = {}
    for r in got:
        text = old[r.doc_id]
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.pii_spans.split(",") if s)]
        assert sorted(s for s in spans if s[0] in ("email", "card", "phone", "ip")) == sorted(_found(text or ""))
        if not spans:
            assert r.text == text
            continue
        at = place = 0
        for kind, a, b in spans:  # everything between the values stays; all but addresses keep their length
            assert r.text[place : place + a - at] == text[at:a]
            place += a - at
            new = re.match(r"[0-9.]*[0-9]", r.text[place:])[0] if kind == "ip" else r.text[place : place + b - a]
            assert images.setdefault((kind, text[a:b]), new) == new
            at, place = b, place + len(new)
        assert r.text[place:] == text[at:]
    assert len(set(images.values())) == len(images)  # different values stay different


@pytest.mark.parametrize("unit", ["bob.%d@mail8.example.com ", "70.1.2.%d ", "4111111111111111 ", "a@", "a@a.", "+1 (988) 555-2485 ", "1.", "1984-02-28 "])
def test_a_long_text_takes_linear_time(unit):
    many = lambda n: "".join(unit % (k % 250) if "%" in unit else unit for k in range(n // len(unit)))
    begun = time.monotonic()
    text = many(1_000_000)
    new, spans = pii.pseudonymise(text, pii.Pseudonyms(KEY))
    assert time.monotonic() - begun < 60  # with a look at every value for every other it is hours
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:])) and (len(new) >= len(text) // 2)
