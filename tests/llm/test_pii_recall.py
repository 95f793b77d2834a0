"""PII: every planted value of every form is found, clean text stays, and the search finds what a search of all places and lengths finds."""

import random

import pytest

from orderlens.llm import pii

FILLER = "the quick note of 12 pages , see section 3.4 or room 7b and 1,250 units at 10:30 for 99 euros".split()
MONTHS = "January March may Oct. September März avril août diciembre".split()


def planted(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    day, month, year = rng.randrange(1, 29), rng.randrange(1, 13), rng.randrange(1950, 2040)
    body = rng.choice("456") + d(14)
    card = body + pii.luhn_digit(body)
    area = f"{rng.choice('23456789')}{d(2)}"
    exchange = f"{rng.choice('23456789')}{d(2)}"
    ssn = (f"{rng.randrange(1, 600):03}", f"{rng.randrange(1, 100):02}", f"{rng.randrange(1, 10000):04}")
    account = d(18)
    iban = f"DE{98 - int(account + '131400') % 97:02}{account}"
    name = "".join(rng.choice("abcdéñöжя") for _ in range(6))
    return {
        "card": [card, " ".join(card[i : i + 4] for i in range(0, 16, 4)), "-".join(card[i : i + 4] for i in range(0, 16, 4))],
        "phone": [f"+1 {area} {exchange} {d(4)}", f"({area}) {exchange}-{d(4)}", f"{area}-{exchange}-{d(4)}", f"+44 20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"030 {d(4)} {d(4)}", f"0161 {d(3)} {d(4)}", f"+49 30 {d(4)} {d(4)}"],
        "date": [f"{year}-{month:02}-{day:02}", f"{day}/{month}/{year}", f"{day:02}.{month:02}.{year}", f"{year}-{month:02}-{day:02}T10:20:30Z", f"{day} {rng.choice(MONTHS[:3])} {year}", f"March {day}, {year}", f"{day}. {MONTHS[5]} {year}", f"{day} {MONTHS[7]} {year}", f"{day} de diciembre de {year}", f"{day}/{month}/{year % 100:02}", f"{day:02}.{month:02}.{year % 100:02}"],
        "ssn": ["-".join(ssn), " ".join(ssn), "SSN " + "".join(ssn), "social security number: " + "".join(ssn)],
        "iban": [iban, " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))],
        "email": [f"{name}.{name}@mail.example.com", f"a{d(3)}@x-y.org"],
        "ip": [".".join(str(rng.randrange(1, 255)) for _ in range(4))],
        "ip6": [f"2001:db8::{rng.randrange(1, 65535):x}:{rng.randrange(1, 65535):x}"],
        "secret": ["".join(rng.choice("0123456789abcdef") for _ in range(40))],
        "token": ["AKIA" + "".join(rng.choice("ABCDEFGH01234567") for _ in range(16)), "ghp_" + "".join(rng.choice("abcXYZ019") for _ in range(36))],
    }


def test_recall_of_planted_values():
    rng = random.Random(77)
    found = total = 0
    for _ in range(120):
        for kind, values in planted(rng).items():
            for value in values:
                before, after = " ".join(rng.choices(FILLER, k=6)), " ".join(rng.choices("and then we saw that they left".split(), k=5))
                text, counts = pii.pseudonymise(f"{before} {value} {after}.")
                total += 1
                found += counts.get(kind, 0) == 1 and value not in text and text.startswith(before) and text.endswith(after + ".")
    assert found / total > 0.995, (found, total)


def test_clean_text_stays():
    rng = random.Random(5)
    for _ in range(500):
        text = " ".join(rng.choices([*FILLER, "v1.2.10", "3/4", "1/2/3", "12 of May", "id 123456789", "2021-13-45 or so", "May 5 it is", "0.5 - 0.75 x"], k=30))
        if "12 of May" not in text:
            assert pii.pseudonymise(text) == (text, {})


def every_place(text, key):
    """All places, all forms in order, all lengths: the first valid value of each place, and on from its end."""
    out, found, at = [], {}, 0
    while at < len(text):
        hit = None
        opened = pii.ANY.match(text, at)
        if opened:
            hit = pii.valid(opened, key, every_place.other_end > at)
            if hit is None and opened["card"] is None:
                every_place.other_end = max(every_place.other_end, opened.end())
        if hit:
            kind, end, new = hit
            kind = kind.removeprefix("named_")
            found[kind] = found.get(kind, 0) + 1
            out.append(new)
            at = end
        else:
            out.append(text[at])
            at += 1
    return "".join(out), found


def test_search_against_every_place():
    rng = random.Random(11)
    for _ in range(300):
        values = [rng.choice(v) for v in planted(rng).values()]
        text = " ".join(x if rng.random() < 0.8 else x[: len(x) // 2] + x[len(x) // 2 + 1 :] for x in rng.choices(values + FILLER, k=12))
        every_place.other_end = 0
        assert pii.pseudonymise(text) == every_place(text, pii.DEFAULT_KEY)


def test_keys():
    long = b"k" * 64
    assert pii.pseudonymise("10.1.2.3", long + b"1") != pii.pseudonymise("10.1.2.3", long + b"2")
    with pytest.raises(ValueError):
        pii.pseudonymise("10.1.2.3", b"")


def test_letters_of_all_alphabets_change_within_their_kind():
    for value in ("josé.ñandú@example.com", "иванов@example.com", "ÀÉÎÕÜ.Ångström@example.com", "γιώργος7@example.com"):
        text, found = pii.pseudonymise(value)
        name, new = value.rpartition("@")[0], text.rpartition("@")[0]
        assert found == {"email": 1} and len(name) == len(new) and all((a.islower(), a.isupper(), a.isalnum()) == (b.islower(), b.isupper(), b.isalnum()) for a, b in zip(name, new))
        assert sum(a != b for a, b in zip(name, new) if a.isalnum()) >= len(name) // 2
    assert pii.pseudonymise("4111 1111 1111 1111")[0][0] == "4" and pii.pseudonymise("020 7946 0958")[0][0] == "0"


def test_named_dates_are_linked_to_numbers():
    year, month, day = pii.pseudonymise("2021-03-14")[0].split("-")
    names = {n: [str(names.index(names[int(month) - 1]) + 1)] for names in pii.MONTHS for n in (names[int(month) - 1],)}
    for text in ("14 March 2021", "14. März 2021", "14 mars 2021", "14 de marzo de 2021", "March 14th, 2021", "14 Mar 2021"):
        new = pii.pseudonymise(text)[0]
        assert year in new and any(n in new.lower() for n in names) and str(int(day)) in new
