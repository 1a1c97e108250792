"""The small labelled table the personal-data model is trained from.

Sentences mark their spans as ``{kind}``; values are made by rule from a fixed seed, so
the table is the same everywhere. Sentences without a mark are counter-examples: numbers
and strings that look private and are not.
"""

from __future__ import annotations

import random
import re

SEED, COPIES = 11, 10

# Frames in the languages of the corpus.
FRAMES = [
    "write to {email} for the list of rooms", "contact: {email}, or come by", "mail {email}",
    "you can reach her at {email} until noon", "schreiben Sie an {email} bis morgen", "écrivez à {email} avant midi",
    "escribe a {email} por favor", "his address is {email}.", "from {email} to {email} yesterday",
    "call {phone} after six", "phone {phone} or ask at the desk", "tel. {phone}", "rufen Sie {phone} an",
    "appelez le {phone} demain matin", "llame al {phone} hoy", "fax {phone}, room twelve", "her number is {phone}.",
    "blocked {ip} at the gate", "the host {ip} did not answer", "server {ip} port closed", "von {ip} kam nichts",
    "depuis {ip} sans réponse", "desde {ip} ayer", "login from {ip}.", "ping {ip} failed twice",
    "paid with card {card} today", "card number {card} was refused", "Karte {card} gesperrt", "carte {card} perdue",
    "tarjeta {card} robada", "charge {card} for the rest", "the {card} on file",
    "token = {secret} in the file", "api_key: {secret}", "password={secret} was reset", "secret {secret} leaked",
    "the key is {secret} for now", "clé {secret} à garder", "Schlüssel {secret} geheim", "clave {secret} guardada",
    "and the of to with from that was", "the house stood at the end of the road, and nobody came.",
    "in {year} the town had {count} people", "version {version} came out in {year}", "see section {version} on page {small}",
    "Licensed under the Apache License, Version 2.0.", "the GNU General Public License, version 3.", "on {date} we met at {clock}",
    "it cost {price} and weighed {small} kg", "chapter {small}: the {small} winds", "about {count} of {count} were lost",
    "room {small}, floor {small}", "und im Jahr {year} waren es {count}", "en {year}, il y avait {count} maisons",
    "the ratio was {decimal} to {decimal}", "isbn 978-3-16-148410-0 is out of print", "order #{small} of {date}",
    "a@b is not a word", "use +{small} or -{small}", "text*** with### marks&&& and%%% signs$$$", "LOUD!! WORDS!! HERE!!",
    "one | two | three | four | five", "colour #a0b1c2 on white", "commit a1b2c3d merged", "build {small}a of release r{small}",
]

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _word(r: random.Random, low: int = 3, high: int = 9) -> str:
    return "".join(r.choice(_LETTERS) for _ in range(r.randint(low, high)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _card(r: random.Random, n: int) -> str:
    head = _digits(r, n - 1)
    return next(head + c for c in "0123456789" if luhn(head + c))


def _value(kind: str, r: random.Random) -> str:
    if kind == "email":
        host = f"{_word(r)}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"
        user = r.choice([_word(r), f"{_word(r)}.{_word(r)}", f"{_word(r)}{r.randint(1, 99)}", f"{_word(r)}.{r.randint(1, 99)}"])
        return r.choice([f"{user}@{host}", f"{user}@mail{r.randint(1, 9)}.{host}", f"{user}[at]{host}", f"{user}(at){host}",
                         f"{user} [at] {host}", f"{user} (at) {host}", f"{user}@{host}"])
    if kind == "ip":
        four = ".".join(str(r.randint(1, 255)) for _ in range(4))
        six = ":".join(f"{r.randint(256, 65535):x}" for _ in range(8))
        return r.choice([four, four, six, f"{six[:9]}::{r.randint(1, 255):x}"])
    if kind == "card":
        n = _card(r, 16)
        sep = r.choice(["", "", " ", "-", ".", "/"])
        return sep.join(n[i:i + 4] for i in range(0, 16, 4)) if sep else r.choice([n, _card(r, 19), _card(r, 15)])
    if kind == "phone":
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {a} {b}{c}", f"+33 {a}.{b}.{c}",
                         f"00{r.randint(30, 49)} {a} {b}{c}", f"{a}.{b}.{c}"])
    if kind == "secret":
        hexa = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64])))
        mixed = "".join(r.choice(_LETTERS + _LETTERS.upper() + "0123456789") for _ in range(r.randint(20, 48))) + _digits(r, 2)
        s = r.choice([hexa, hexa, mixed, hexa.upper()])
        return r.choice([s, f'"{s}"', f"'{s}'", s])
    return {"year": str(r.randint(1500, 2030)), "count": r.choice([str(r.randint(2, 99999)), f"{r.randint(1, 99)},{_digits(r, 3)}"]),
            "version": ".".join(str(r.randint(0, 12)) for _ in range(r.randint(2, 3))), "small": str(r.randint(1, 400)),
            "date": r.choice([f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
                              f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}"]),
            "clock": f"{r.randint(0, 23)}:{r.randint(10, 59)}", "price": f"${r.randint(1, 900)}.{r.randint(10, 99)}",
            "decimal": f"{r.randint(0, 99)}.{r.randint(0, 9999)}"}[kind]


PRIVATE = ("email", "ip", "card", "phone", "secret")


def labelled(seed: int = SEED, copies: int = COPIES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, start, end)]) rows: every frame ``copies`` times."""
    r, rows = random.Random(seed), []
    for frame in FRAMES:
        for _ in range(copies if "{" in frame else 1):
            text, spans, at = "", [], 0
            for m in re.finditer(r"\{(\w+)\}", frame):
                text += frame[at:m.start()]
                value = _value(m[1], r)
                if m[1] in PRIVATE:
                    spans.append((m[1], len(text), len(text) + len(value)))
                text += value
                at = m.end()
            text += frame[at:]
            end = r.choice(["", "", ".", ",", "***", "!!", " |"])
            rows.append((text + end, spans))
    return rows
