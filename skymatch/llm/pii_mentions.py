"""Labelled spans to learn personal data from: made-up mentions in many notations, look-alikes, and windows around them."""

from __future__ import annotations

import random
from collections.abc import Callable

from .pii_model import WINDOW, Span

DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENDINGS = ("com", "org", "net", "de", "fr", "es", "io", "info", "edu", "co.uk")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits(r: random.Random, n: int) -> str:
    return "".join(r.choice(DIGITS) for _ in range(n))


def word(r: random.Random, a: int, b: int) -> str:
    """Letters at random, or syllables."""
    if r.random() < 0.4:
        return "".join(r.choice(LETTERS) for _ in range(r.randint(a, b)))
    out = ""
    while len(out) < a:
        out += r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") + r.choice(["", "", "n", "r", "s"])
    return out[: max(b, a)]


def _email(at: Callable[[random.Random], str], dot: Callable[[random.Random], str]) -> Callable[[random.Random], str]:
    def make(r: random.Random) -> str:
        d, parts = dot(r), [word(r, 2, 9)]
        if r.random() < 0.5:
            parts.append(r.choice([word(r, 3, 10), digits(r, 2)]))
        name = (d if r.random() < 0.7 else r.choice("_-")).join(parts) + (digits(r, r.randint(1, 4)) if r.random() < 0.2 else "")
        host = [word(r, 3, 10) + (digits(r, 1) if r.random() < 0.2 else ""), *r.choice(ENDINGS).split(".")]
        if r.random() < 0.4:
            host.insert(0, word(r, 3, 8))
        return name + at(r) + d.join(host)

    return make


def _fixed(*forms: str) -> Callable[[random.Random], str]:
    return lambda r: r.choice(forms)


def _ip(sep: Callable[[random.Random], str]) -> Callable[[random.Random], str]:
    def make(r: random.Random) -> str:
        return sep(r).join(str(r.choice([r.randint(0, 255), r.randint(10, 255), 10, 192, 168])) for _ in range(4))

    return make


def _card(sep: Callable[[random.Random], str]) -> Callable[[random.Random], str]:
    def make(r: random.Random) -> str:
        body = r.choice("3456") + digits(r, 14)
        body += next(c for c in DIGITS if luhn(body + c))
        return sep(r).join(body[i : i + 4] for i in range(0, 16, 4))

    return make


def _phone(form: Callable[[random.Random, str], str], seps: tuple[str, ...]) -> Callable[[random.Random], str]:
    return lambda r: form(r, r.choice(seps))


def _national(r: random.Random, s: str) -> str:
    return s.join((digits(r, 3), digits(r, 3), digits(r, 4)))


def _country(prefix: str) -> Callable[[random.Random, str], str]:
    return lambda r, s: prefix + s.join((str(r.randint(1, 99)), digits(r, r.choice((2, 3))), digits(r, 3), digits(r, 4)))


def _bracketed(r: random.Random, s: str) -> str:
    return r.choice(["", "", f"00{r.randint(1, 99)} ", f"+{r.randint(1, 99)} ", f"{r.randint(1, 9)} "]) + f"({digits(r, 3)}) {digits(r, 3)}{s}{digits(r, 4)}"


def _pairs(r: random.Random, s: str) -> str:
    return "0" + s.join((digits(r, 1), *(digits(r, 2) for _ in range(4))))


#: How each kind is written: the notations of the rules first, then others.
NOTATIONS: dict[str, dict[str, Callable[[random.Random], str]]] = {
    "email": {
        "plain": _email(_fixed("@"), _fixed(".")),
        "spaced": _email(_fixed(" @ ", "@ "), _fixed(".", " . ")),
        "bracketed": _email(_fixed(" [at] ", "[at]", " (at) ", "(at)", " {at} ", " <at> ", " ( at ) "), _fixed(".", " [dot] ", "[dot]", " (dot) ", "(dot)", " . ")),
        "spoken": _email(_fixed(" at ", " AT "), _fixed(" dot ", " DOT ")),
        "joined": _email(_fixed("_at_", "-at-", "(a)", "[@]", "(@)", "*at*"), _fixed(".", "_dot_", "-dot-", "[.]")),
        "foreign": _email(_fixed(" arroba ", " arobase ", " (arroba) ", " klammeraffe ", " [arobase] "), _fixed(" punto ", " point ", " punkt ", " (punto) ", ".")),
    },
    "ip": {
        "plain": _ip(_fixed(".")),
        "spaced": _ip(_fixed(" . ", ". ", " .")),
        "bracketed": _ip(_fixed("[.]", "(.)", "[dot]", "(dot)", " [.] ")),
        "spoken": _ip(_fixed(" dot ", " point ", " punto ")),
    },
    "card": {
        "plain": _card(_fixed("", " ", "-")),
        "dotted": _card(_fixed(".", "_", "/", ":")),
        "wide": _card(_fixed("  ", " - ", "--", " / ", "   ")),
    },
    "phone": {
        "plain": _phone(_country("+"), (" ", "-", ".")),
        "country": _phone(_country("00"), (" ", "-", ".", "/")),
        "national": _phone(_national, ("-", ".", "/", " - ")),
        "bracketed": _phone(_bracketed, ("-", " ", ".")),
        "pairs": _phone(_pairs, (" ", ".", "-")),
        "slashed": _phone(_country("+"), ("/", " / ", " - ", "–")),
    },
}


def mention(kind: str, r: random.Random, notation: str | None = None) -> str:
    return NOTATIONS[kind][notation or r.choice(list(NOTATIONS[kind]))](r)


def lookalike(r: random.Random) -> str:
    """Something with digits, signs or words of mentions that is no personal data."""
    d, w = (lambda n: digits(r, n)), (lambda: word(r, 2, 9))
    x = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    forms = (
        lambda: x(40), lambda: f'key = "{x(32)}"', lambda: f"password={x(18)}", lambda: f"Version {d(1)}.{d(1)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: d(r.randint(1, 7)),
        lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"${d(3)}.{d(2)}", lambda: f"{d(3)},{d(3)},{d(3)}",
        lambda: f"{d(2)}%", lambda: f"@{w()}", lambda: f"AKIA{x(16).upper()}", lambda: f"No. {d(8)}", lambda: f"{d(2)} x {d(2)} x {d(2)}", lambda: x(24), lambda: d(25), lambda: f"{w()} at {w()}",
        lambda: f"{w()} at the {w()}, {w()} at {d(2)}:{d(2)}", lambda: f"the dot on {w()}", lambda: f"{w()} at {w()}. {w().title()} {w()}", lambda: f"at this point {w()}", lambda: f"{w()} punto {w()}",
        lambda: f"{w()} und der Punkt {w()}", lambda: f"{w()} [{w()}] {w()} ({w()})", lambda: f"{d(4)}-{d(4)}", lambda: f"{d(3)} {d(3)}", lambda: f"pp. {d(3)}-{d(3)}", lambda: f"{w()}.{w()}, {w()}/{w()}",
        lambda: f"{w()}={d(4)}&{w()}={w()}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: f"{w()}% {w()}$$$ {w()}###", lambda: f"{d(2)} {w()} {d(4)}", lambda: f"token = \"{x(40)}\"", lambda: f"({w()}) {w()} - {w()}",
        lambda: f"{w()} at {w()}. At {w()} {w()}", lambda: f"At {w()} {w()} {w()}", lambda: f"{w()} AT {w()} {w()}", lambda: f"{w()}. {w().title()} at {w()}.",
    )
    return r.choice(forms)()


def made_up(clean: list[str], n: int, r: random.Random) -> list[tuple[str, list[Span]]]:
    """Windows of clean text with a mention or a look-alike set in; some are cut by the window's ends, as in a search."""
    out: list[tuple[str, list[Span]]] = []
    for i in range(n):
        kind = (None, "email", "phone", "email", None, "ip", "email", "card", "email", "phone")[i % 10]  # addresses have most notations
        inner = mention(kind, r) if kind else lookalike(r)
        c = r.choice(clean)
        at = r.randrange(len(c))
        left, right = c[:at], c[at:]
        left += "" if not left or left[-1].isspace() or r.random() < 0.02 else r.choice([" ", " ", " ", "\n", ": ", " ("])
        right = r.choice([" ", " ", ", ", ". ", "\n", ") ", ""]) + right
        if right[:1].isalnum():
            right = " " + right
        text = left + inner + right
        a, b = len(left), len(left) + len(inner)
        # the window lies so that the mention is whole in it, but for one in ten
        low, high = max(0, b - WINDOW), min(a, max(0, len(text) - WINDOW))
        if r.random() < 0.1:
            low, high = max(0, a + 1 - WINDOW + 6), max(0, min(b - 6, len(text) - 1))
        start = r.randint(min(low, high), max(low, high))
        a, b, text = max(a - start, 0), min(b - start, WINDOW), text[start : start + WINDOW]
        if text:
            out.append((text, [(a, b, kind)] if kind and a < b else []))
    return out


def lookalikes(clean: list[str], n: int, r: random.Random) -> list[tuple[str, list[Span]]]:
    """Windows of clean text with two look-alikes and no mention."""
    out: list[tuple[str, list[Span]]] = []
    for _ in range(n):
        c = r.choice(clean)
        a, b = sorted((r.randrange(len(c)), r.randrange(len(c))))
        text = f"{c[:a]} {lookalike(r)} {c[a:b]} {lookalike(r)} {c[b:]}"
        start = r.randrange(max(1, len(text) - WINDOW + 1))
        out.append((text[start : start + WINDOW], []))
    return out
