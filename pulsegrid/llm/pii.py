"""Personal data: four base patterns and a linear-chain conditional random field.

The base patterns give well-formed spans. The field adds spans that they miss (written-out
addresses, numbers without a plus sign, unusual separators, IPv6): it labels tokens by
word-shape features of a token, its neighbours and the stretch that it lies in. It is trained
on the driver, in some three seconds, from a small labelled table (``TRAINING_ROWS`` bounds it)
and decoded by Viterbi in numpy batches. Its weights, a few thousand rows of numbers whatever
the corpus, travel with the tasks.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import keyed

KINDS = ("email", "ip", "card", "phone")
#: Most labelled rows that training takes.
TRAINING_ROWS = 5_000
#: Tokens on either side of a cue that a sequence holds.
RADIUS = 8
#: Places that are decoded side by side; a longer sequence is decoded alone.
PLACES = 100_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, leftmost and not overlapping within a kind.

    Around an "@" the local part is the longest run before it, so long words without one
    cost nothing; the other patterns read each character a bounded number of times.
    """
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), 0))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), m.end(), 3))
    return found


# --- the field -------------------------------------------------------------------------

#: Labels: 0 outside, then begin and inside of each kind.
N_LABELS = 1 + 2 * len(KINDS)
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|\w")
#: Digits, "@", "dot", a bracketed "at", hexadecimal groups with colons.
_CUE = re.compile(r"[0-9]+|@|\bdot\b|[\[({<]\s?at\s?[\])}>]|\b(?:[a-f]{1,4}:){2,}|::", re.IGNORECASE)
#: Words that stand for themselves among the shapes.
CUE_WORDS = ("at", "dot", "com", "org", "net", "tel", "phone", "call", "fax", "mobile", "card", "ip", "isbn", "version", "id", "order", "date")


def shape(token: str, spaced: bool) -> str:
    """Digits by count and leading zero, letters by case, hexadecimal letters apart, the rest as it is."""
    low = token.lower()
    if token[0].isdigit():
        kind = f"{'z' if token[0] == '0' else 'd'}{min(len(token), 12)}"
    elif token.isalpha():
        kind = low if low in CUE_WORDS else "h" if len(token) <= 4 and not low.strip("abcdef") else ("X" if token[0] != low[0] else "x")
    else:
        kind = token
    return kind + "_" * spaced


@dataclass
class Field:
    """Weights of a trained field: a row per feature, and label transitions."""

    index: dict[tuple, int]
    emit: np.ndarray
    trans: np.ndarray


def tokens(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int, str]]:
    out, before = [], start
    for m in _TOKEN.finditer(text, start, len(text) if end is None else end):
        out.append((m.start(), m.end(), shape(m[0], m.start() > before or m.start() == start)))
        before = m.end()
    return out


@lru_cache(maxsize=10_000)
def _role(shaped: str) -> tuple[str, int, bool]:
    """What a shape can be in a stretch: its role, the digits that it has, whether a space is before it.

    Roles: "n" a number, "h" hexadecimal letters, "s" a separator of numbers, "a" and "." the
    two signs of an address, "" the rest.
    """
    spaced = len(shaped) > 1 and shaped.endswith("_")
    plain = shaped[:-1] if spaced else shaped
    if len(plain) > 1 and plain[0] in "dz" and plain[1:].isdigit():
        return "n", int(plain[1:]), spaced
    if plain in ("at", "@"):
        return "a", 0, spaced
    if plain in ("dot", "."):
        return ("." if plain == "." else "dot"), 0, spaced
    if plain in SEPARATING:
        return "s", 0, spaced
    return ("h" if plain == "h" else ""), 0, spaced


#: Signs that may stand between the numbers of one stretch, the point aside.
SEPARATING = frozenset("()-/_:–|,")
#: How far from its place an address's signs are looked for, in tokens.
REACH = 6
#: Features of a place.
WIDTH = 15


def _stretches(shapes: list[str]) -> list[list[tuple]]:
    """Features of the stretch of numbers, of the hexadecimal groups and of the address that a place lies in."""
    roles, n = [_role(s) for s in shapes], len(shapes)
    out: list[list[tuple]] = [[] for _ in shapes]
    i = 0
    while i < n:  # numbers with separators between them
        if roles[i][0] not in ("n", "s", "."):
            i += 1
            continue
        end = i + 1
        while end < n and roles[end][0] in ("n", "s", "."):
            if roles[end][2] and not roles[end - 1][2] and shapes[end - 1] in (".", ",", ":"):
                break  # the sign belongs to the sentence
            end += 1
        numbers = [j for j in range(i, end) if roles[j][0] == "n"]
        if numbers:
            sizes = [roles[j][1] for j in numbers]
            signs = "".join(sorted({shapes[j].rstrip("_") for j in range(numbers[0], numbers[-1]) if roles[j][0] != "n"}))
            first, total = shapes[numbers[0]].rstrip("_"), min(sum(sizes), 24)
            told = [("total", total), ("first", first, total), ("groups", min(len(sizes), 8), max(sizes)), ("signs", signs, total), ("last", sizes[-1], total)]
            for j in range(i, end):
                inside = "<" if j < numbers[0] else ">" if j > numbers[-1] else "="
                out[j] = [(*t, inside) for t in told]
        i = end
    for j in range(n):
        out[j] += [("none", k) for k in range(5 - len(out[j]))]
    i = 0
    while i < n:  # hexadecimal groups with colons
        end = i
        while end < n and (roles[end][0] in ("n", "h") or shapes[end].rstrip("_") == ":") and (end == i or not roles[end][2]):
            end += 1
        own = [s.rstrip("_") for s in shapes[i:end]]
        colons = own.count(":")
        double = any(a == b == ":" for a, b in zip(own, own[1:]))
        for j in range(i, max(end, i + 1)):
            out[j].append(("hex", min(colons, 8), double))
        i = max(end, i + 1)
    ats = [j for j in range(n) if roles[j][0] == "a"]
    for j in range(n):  # the nearest signs of an address
        at = min((a - j for a in ats if abs(a - j) <= REACH), key=abs, default=99)
        dot = min((d - j for d in range(max(0, j - REACH), min(n, j + REACH + 1)) if roles[d][0] in (".", "dot")), key=abs, default=99)
        out[j] += [("at", at), ("at, dot", at, dot)]
    return out


def _features(index: dict, shapes: list[str], grow: bool = False) -> list[list[int]]:
    pad = ["^", "^", *shapes, "$", "$"]
    rows = []
    for i, wide in enumerate(_stretches(shapes), 2):
        keys = [(o, pad[i + o]) for o in (-2, -1, 0, 1, 2)] + [(9, pad[i - 1] + " " + pad[i]), (8, pad[i] + " " + pad[i + 1]), *wide]
        rows.append([index.setdefault(k, len(index)) if grow else index.get(k, 0) for k in keys])
    return rows


def _gradient(x: np.ndarray, y: np.ndarray, mask: np.ndarray, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected less seen counts of shapes and transitions, by forward and backward passes of scaled probabilities."""
    n, longest, _ = x.shape
    e = np.zeros((n, longest, N_LABELS))
    e[mask] = emit[x[mask]].sum(1)
    own, step = np.exp(e - e.max(2, keepdims=True)), np.exp(trans)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = own[:, 0] / own[:, 0].sum(1, keepdims=True)
    for t in range(1, longest):
        new = (alpha[:, t - 1] @ step) * own[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new / new.sum(1, keepdims=True), alpha[:, t - 1])
    expected = np.zeros_like(trans)
    for t in range(longest - 1, 0, -1):
        live = mask[:, t]
        ahead = own[:, t] * beta[:, t]
        before = ahead @ step.T
        weight = (alpha[:, t - 1] * before).sum(1, keepdims=True)
        expected += step * ((alpha[:, t - 1] / weight)[live].T @ ahead[live])
        beta[:, t - 1] = np.where(live[:, None], before / before.sum(1, keepdims=True), 1)
    prob = alpha * beta
    wrong = (prob / prob.sum(2, keepdims=True))[mask]
    wrong[np.arange(len(wrong)), y[mask]] -= 1
    rows, by_shape = x[mask], np.empty_like(emit)
    for c in range(N_LABELS):
        by_shape[:, c] = np.bincount(rows.ravel(), np.repeat(wrong[:, c], WIDTH), len(emit))
    by_shape[0] = 0  # an unknown shape tells nothing
    both = mask[:, 1:]
    np.subtract.at(expected, (y[:, :-1][both], y[:, 1:][both]), 1)
    return by_shape, expected


def train(labelled: list[tuple[str, list[tuple[int, int, str]]]], steps: int = 80, batch: int = 512) -> Field:
    """Maximum likelihood by Adam over batches; ``labelled`` holds (text, [(start, end, kind)])."""
    if len(labelled) > TRAINING_ROWS:
        raise ValueError(f"more than {TRAINING_ROWS} labelled rows")
    index: dict = {(0, ""): 0}
    feats, golds = [], []
    for text, spans in labelled:
        toks = tokens(text)
        gold = np.zeros(len(toks), int)
        for s, e, kind in spans:
            inside = [i for i, t in enumerate(toks) if s <= t[0] and t[1] <= e]
            gold[inside] = 2 + 2 * KINDS.index(kind)
            gold[inside[0]] -= 1
        feats.append(_features(index, [t[2] for t in toks], True))
        golds.append(gold)
    n, longest = len(feats), max(map(len, feats))
    x = np.zeros((n, longest, WIDTH), int)
    y = np.zeros((n, longest), int)
    mask = np.zeros((n, longest), bool)
    for i, (f, g) in enumerate(zip(feats, golds)):
        x[i, : len(f)], y[i, : len(g)], mask[i, : len(g)] = f, g, True
    emit, trans = np.zeros((len(index), N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    state = [np.zeros_like(a) for a in (emit, emit, trans, trans)]
    rng, waiting = np.random.default_rng(0), np.zeros(0, int)
    for step in range(1, steps + 1):
        if not len(waiting):
            waiting = rng.permutation(n)
        rows, waiting = waiting[:batch], waiting[batch:]
        own = x[rows], y[rows], mask[rows]
        width = int(own[2].sum(1).max())
        grads = _gradient(*(a[:, :width] for a in own), emit, trans)
        rate = 0.1 * min(1, 2 * (1 - step / (steps + 1)))
        for k, (w, g) in enumerate(zip((emit, trans), grads)):
            g = g / len(rows) + 1e-4 * w
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
            w -= rate * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return Field(index, emit.astype(np.float32), trans.astype(np.float32))


def viterbi(field: Field, shapes: list[list[str]]) -> list[np.ndarray]:
    """The best labels of each sequence; sequences of like length run side by side."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(shapes)
    order = sorted((i for i, s in enumerate(shapes) if s), key=lambda i: len(shapes[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(shapes[order[to]]) <= PLACES:
            to += 1
        batch, at = order[at:to], to
        sizes = np.array([len(shapes[i]) for i in batch])
        longest = int(sizes.max())
        x = np.zeros((len(batch), longest, WIDTH), np.int64)
        for row, i in enumerate(batch):
            x[row, : len(shapes[i])] = _features(field.index, shapes[i])
        e = field.emit[x].sum(2)
        best, back = e[:, 0], np.zeros((longest, len(batch), N_LABELS), np.int8)
        for t in range(1, longest):
            scores = best[:, :, None] + field.trans
            back[t] = scores.argmax(1)
            best = np.where((t < sizes)[:, None], scores.max(1) + e[:, t], best)
        label = best.argmax(1)
        path = np.zeros((len(batch), longest), np.int64)
        rows = np.arange(len(batch))
        for t in range(longest - 1, -1, -1):
            live = t < sizes
            path[live, t] = label[live]
            label = np.where(live, back[t][rows, label], label)
        for row, i in enumerate(batch):
            out[i] = path[row, : sizes[row]]
    return out


def _sequences(text: str) -> list[list[tuple[int, int, str]]]:
    """Token runs around the cues within a line: nothing else can hold a span."""
    out = []
    if not _CUE.search(text):
        return out
    for line in re.finditer(r"[^\n]+", text):
        cues = [m.span() for m in _CUE.finditer(text, line.start(), line.end())]
        if not cues:
            continue
        toks, marks, at = tokens(text, line.start(), line.end()), [], 0
        for i, t in enumerate(toks):
            while at < len(cues) and cues[at][1] <= t[0]:
                at += 1
            if at < len(cues) and cues[at][0] < t[1]:
                marks.append(i)
        begin = end = -1
        for i in marks:
            if begin >= 0 and i - RADIUS <= end:
                end = i + RADIUS
                continue
            if begin >= 0:
                out.append(toks[begin:end])
            begin, end = max(0, i - RADIUS), i + RADIUS
        if begin >= 0:
            out.append(toks[begin:end])
    return out


#: A point in brackets, as addresses are written so that nothing links to them.
_DOTTED = re.compile(r"[\[(]\.[\])]")


def _valid(kind: int, found: str) -> bool:
    """Whether a labelled stretch has the substance of its kind."""
    digits = _NOT_DIGIT.sub("", found)
    if kind == 0:
        plain = re.sub(r"\s*[\[({<]?\s*(?:\bat\b|@)\s*[\])}>]?\s*", "@", found, flags=re.IGNORECASE)
        plain = re.sub(r"\s*[\[({]?\s*(?:\bdot\b|\.)\s*[\])}]?\s*", ".", plain, flags=re.IGNORECASE)
        return re.fullmatch(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", plain) is not None
    if kind == 1:
        try:
            return ipaddress.ip_address(_DOTTED.sub(".", found)) is not None
        except ValueError:
            return False
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    return 10 <= len(digits) <= 15 and not re.search(r"[^\W\d]", found)


_MORE_DOMAIN = re.compile(r"(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+)[\w-]+)*", re.IGNORECASE)


def _snap(kind: int, text: str, s: int, e: int, floor: int) -> tuple[int, int]:
    """The labelled stretch with its ends where its kind can begin and end, at or after ``floor``."""
    while s < e and not (text[s].isalnum() or text[s] in "(:" and kind in (1, 3)):
        s += 1
    while s < e and not (text[e - 1].isalnum() or kind == 1 and text[e - 2 : e] == "::"):
        e -= 1
    if kind == 0:
        while s > floor and (text[s - 1].isalnum() or text[s - 1] in "._%+-"):
            s -= 1
        while s < e and text[s] in ".%+-":
            s += 1
        e = _MORE_DOMAIN.match(text, e).end()
    elif kind == 3:
        inner = text[s:e]
        if inner.count(")") > inner.count("(") and s > floor and text[s - 1] == "(":
            s -= 1
        elif inner.startswith("(") and ")" not in inner:
            s += 1
    return s, e


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) that the field finds in each text."""
    owners, seqs = [], []
    for i, text in enumerate(texts):
        own = _sequences(text)
        seqs += own
        owners += [i] * len(own)
    out: list[list] = [[] for _ in texts]
    for i, seq, labels in zip(owners, seqs, viterbi(field, [[t[2] for t in s] for s in seqs])):
        at = 0
        while at < len(seq):
            if not labels[at]:
                at += 1
                continue
            kind, end = (labels[at] - 1) // 2, at + 1
            while end < len(seq) and labels[end] == 2 + 2 * kind:
                end += 1
            s, e = _snap(kind, texts[i], seq[at][0], seq[end - 1][1], out[i][-1][1] if out[i] else 0)
            if s < e and _valid(kind, texts[i][s:e]):
                out[i].append((s, e, int(kind)))
            at = end
    return out


# --- the small labelled table ------------------------------------------------------------

#: "#" stands for a digit; a tuple holds (kind or "", forms).
FORMS = (
    ("phone", ("(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "1-###-###-####", "0## #### ####", "00## ### #######", "0#### ######", "0### #######", "1 (###) ###-####",
               "(###)###-####", "00 ## ### #######", "00 ## ## ### ####", "00##-###-###-###",
               "0##{s}####{s}####", "0####{s}######", "1{s}###{s}###{s}####", "###{s}###{s}####")),
    ("email", ("{w}{at}{w}{dot}{t}",) * 4 + ("{w}.{w}{at}{w}{dot}{t}", "{w}_{w}{at}{w}{dot}{t}", "{w}##{at}{w}{dot}{t}", "{w}-{w}{at}{w}{dot}{w}{dot}{t}", "{w}{at}{w}{dot}{w}{dot}{t}", "{w} [at] {w}.{t}", "{w}(at){w}.{t}", "{w} @ {w} . {t}")),
    ("ip", ("2001:db8:0:0:8:800:200c:417a", "fe80::1ff:fe23:4567:890a", "2001:db8::1", "10[.]#[.]#[.]1", "192[.]168[.]1[.]##", "beef:cafe::fade", *["{6}"] * 8)),
    ("card", ("4###.####.####.####", "5###_####_####_####", "4###/####/####/####", "3###.######.#####", "4###  ####  ####  ####")),
    ("", ("20##-0#-1#", "1#:##:##", "1.#.#", "#,###,###", "978-#-##-######-#", "####", "##.##", "page ##", "## dot ##", "$##.##", "order ########", "id #############", "v#.#.#.#",
          "20##-####-####", "####-####-####", "##/##/20##", "a::b", "std::{w}::{w}", "look (at) it", "#### ####", "###-####", "#### - ####", "{w}: ####, {w}: ##", "##,##,##,##,##", "#.#e-##")),
)
CONTEXTS = ("{}", "call {} now", "tel: {}", "reach me on {}, or", "the {} of it", "write to {} today.", "card {} ends", "from {} and then", "is {}.", "({})", "see {} for it", "id: {};")
NAMES = ("anna", "bob", "mail", "example", "host", "info", "site", "jo")
ENDS = ("com", "org", "net", "fr", "info", "gov")
AT = (" at ", " at ", " at ", " [at] ", " (at) ", "(at)", "[at]")
SEPARATORS = (" ", "-", ".")
DOT = (" dot ", " dot ", " dot ", " [dot] ", " (dot) ", "(dot)", "[dot]")


def _ipv6(rng: np.random.Generator) -> str:
    """A random address of version 6, mostly with its longest run of zeros left out."""
    groups = ["%x" % rng.integers(1, 16 ** int(rng.integers(1, 5))) for _ in range(8)]
    if rng.random() < 0.8:
        at, n = int(rng.integers(1, 6)), int(rng.integers(2, 6))
        return ":".join(groups[:at]) + "::" + ":".join(groups[at + n :])
    return ":".join(groups)


def labelled_table(seed: int = 7, each: int = 1) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """A few hundred sentences with their spans, from forms and contexts."""
    rng, out = np.random.default_rng(seed), []
    for kind, forms in FORMS:
        for form in forms:
            for context in CONTEXTS:
                for _ in range(each):
                    one = re.sub("#", lambda _: str(rng.integers(10)), form)
                    at, dot = AT[rng.integers(len(AT))], DOT[rng.integers(len(DOT))]
                    one = one.replace("{at}", at).replace("{dot}", dot).replace("{6}", _ipv6(rng)).replace("{s}", SEPARATORS[rng.integers(len(SEPARATORS))])
                    one = re.sub(r"\{w\}", lambda _: "{v}-{v}" if kind == "email" and rng.random() < 0.1 else "{v}", one)
                    one = re.sub(r"\{v\}", lambda _: NAMES[rng.integers(len(NAMES))], one)
                    one = re.sub(r"\{t\}", lambda _: ENDS[rng.integers(len(ENDS))], one)
                    if kind == "card":  # the last digit is the check digit
                        one = next(one[:-1] + d for d in "0123456789" if luhn(_NOT_DIGIT.sub("", one[:-1] + d)))
                    at = context.index("{}")
                    out.append((context.replace("{}", one), [(at, at + len(one), kind)] if kind else []))
    return out


# --- forms drawn from grammars -------------------------------------------------------------

#: Parts of the drawn forms: trained on, looked at while the grammars and features were made, kept apart.
PARTS = ("train", "train", "train", "look", "blind")
#: Sentences around the drawn forms; those for the other parts are in the tests.
DRAWN_CONTEXTS = (*CONTEXTS, "{}", "contact: {}", "her number was {} then", "you can use {} for that", "{}, {w}", "{w} {w} {}", "as {w} said: {}", "\"{}\"", "{w} = {}", "- {}", "{} / {w}", "{w}, {} and {w}", "try {}?", "Our {w} is {}")
SYLLABLES = ("an", "ba", "ce", "do", "el", "fi", "gu", "ho", "in", "ja", "ko", "li", "mar", "nor", "os", "pe", "qui", "ra", "sun", "ter", "ul", "vi", "wo", "ya", "zen")
TOPS = ("com", "org", "net", "io", "de", "fr", "edu", "ch", "dev", "nl", "eu", "info", "at", "es", "it")


def _of(rng: np.random.Generator, options):
    return options[int(rng.integers(len(options)))]


def _phone_form(rng: np.random.Generator) -> str:
    """A national number form: a way to begin, an area and groups of two to four digits, ten to fifteen in all."""
    sep, begin = _of(rng, (" ", " ", "-", ".", "/", " - ")), _of(rng, ("0", "0", "(0", "(0", "00", "1", "(", ""))
    if begin in ("1", "(", ""):
        area = {"1": _of(rng, ("1" + sep + "###" + sep, "1 (###) ", "1-###-")), "(": _of(rng, ("(###) ", "(###)", "(###)-")), "": "###" + sep}[begin]
        return area + "###" + _of(rng, (sep, sep, "-", ".")) + "####"
    area = begin + "#" * int(rng.integers(1, 5)) + {"(0": _of(rng, (") ", ")", ")-"))}.get(begin, sep)
    if begin == "00":
        area = "00##" + _of(rng, (sep, sep, "")) + "#" * int(rng.integers(1, 4)) + sep
    left = int(rng.integers(10, 12 if begin != "00" else 15)) - sum(c in "0#" for c in area)
    groups = []
    while left > 0:
        size = left if left <= 3 or rng.random() < 0.25 and left <= 8 else int(rng.integers(2, min(5, left - 1)))
        groups.append("#" * size)
        left -= size
    return area + sep.join(groups)


def _card_form(rng: np.random.Generator) -> str:
    """A brand's grouping with a separator that the base pattern does not read."""
    sizes = _of(rng, ((4, 4, 4, 4),) * 4 + ((4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (8, 8), (4, 12)))
    sep = _of(rng, (".", "/", "_", ":", "  ", " . ", " / ", "--", " - ", "–", ",", "|", " | ", "   "))
    first = _of(rng, ("3", "4", "5", "6"))
    return first + sep.join("#" * k for k in sizes)[1:]


def _ip_form(rng: np.random.Generator) -> str:
    """Version 4 with points in brackets, or groups of version 6 (% a hexadecimal digit, & in capitals)."""
    if rng.random() < 0.25:
        dot = _of(rng, ("[.]", "(.)"))
        parts = [_of(rng, ("10", "#", "1#", "192", "172", "1##", "##")) for _ in range(4)]
        some = _of(rng, ((1, 1, 1), (0, 0, 1), (1, 0, 0), (0, 1, 0), (0, 1, 1)))
        return parts[0] + "".join((dot if bracketed else ".") + p for bracketed, p in zip(some, parts[1:]))
    digit = _of(rng, ("%", "%", "%", "&"))
    groups = [digit * int(rng.integers(1, 5)) for _ in range(8)]
    groups[0] = _of(rng, ("2" + digit * 3, "fe80", "fd" + digit * 2, digit * 4, "2001"))
    if rng.random() < 0.15:
        return ":".join(g if rng.random() < 0.7 else "0" for g in groups)
    at, n = int(rng.integers(1, 5)), int(rng.integers(2, 5))
    return ":".join(groups[:at]) + "::" + ":".join(groups[at + n :])


def _email_form(rng: np.random.Generator) -> str:
    """A local part, a sign of at, a domain and signs of dot, not both signs plain."""
    local = _of(rng, ("{w}", "{w}", "{w}.{w}", "{w}_{w}", "{w}-{w}", "{w}##", "{w}#", "{w}.{w}##", "{w}+{w}", "{c}", "{c}.{c}"))
    host = _of(rng, ("{w}", "{w}", "{w}-{w}", "{w}#", "{w}.{w}", "{w}{dot}{w}"))
    at = _of(rng, (" at ", " at ", " AT ", " [at] ", " (at) ", "(at)", "[at]", " { at }", "{at} ", "<at>", " <at> ", " @ ", "@"))
    dots = (" dot ", " dot ", " DOT ", " [dot] ", " (dot) ", "(dot)", "[dot]", " { dot } ", "{dot}")
    dot = _of(rng, dots if at in (" at ", " AT ", "@") else dots + (".", ".", "." if at != " @ " else " . "))
    return local + at + host.replace("{dot}", dot) + dot + "{t}"


def _other_form(rng: np.random.Generator) -> str:
    """What looks like personal data and is none: dates, times, amounts, codes, ratios, scope names, plain prose."""
    sep = _of(rng, ("-", "/", ".", ":", " "))
    one = ("20##" + sep + "0#" + sep + "1#", "1#:##" + _of(rng, ("", ":##", ":##.###")), "#.##.#", "$#,###,###", "#,###,###.##", "978-#-##-######-#", "978 # #### #### #", "97###########",
           "{c}{c}-####-####", "%%%%%%%%-%%%%-4%%%-9%%%-%%%%%%%%%%%%", "%%:%%:%%:%%:%%:%%", "{w}::{w}", "std::{w}", "{c}::{c}::{w}", "#:#", "##:##", "##-##, ##-##, #-##", "19##-20##", "{w} at ##:##",
           "at the dot", "dot {w}", "the {w} dot on {w}", "{w} at {w}", "look at the dot", "at the {w} dot", "at the dot of ##", "{w} at a dot", "{w} at the dot in {w}", "polka dot {w} at {w}", "####{s}####", "1###{s}####{s}##", "page ## of ###", "v#.#.#", "#.#.#-rc#", "##.####, -#.####",
           "order ########", "id ##########", "no. ############", "#### #### ####", "## %", "#e-##", "{w} @ ##", "@{w}", "{w}@##", "(####)", "[##]", "##, ##, ##, ##", "## ## ##", "#/##", "{c} ##:##-##", "#:#::#:#", "##x##", "20######T######", "{w}{w}## dot {w}", "####-####-###-##", "#-#-#-#-#-#")
    form = _of(rng, one).replace("{s}", _of(rng, SEPARATORS))
    return form if rng.random() < 0.5 else form + _of(rng, (" {w}", ", ##", " and ##", "; {w} ##", " ({w})"))


GRAMMARS = {"phone": _phone_form, "email": _email_form, "ip": _ip_form, "card": _card_form, "": _other_form}


def drawn_forms(kind: str, part: str, draws: int = 400, seed: int = 11) -> list[str]:
    """The distinct forms of some hundred draws that fall to a part, by a hash of the form."""
    rng = np.random.default_rng([seed, len(kind), len(KINDS)])
    forms = dict.fromkeys(GRAMMARS[kind](rng) for _ in range(draws))
    return [f for f in forms if PARTS[hashlib.sha256(f.encode()).digest()[0] % len(PARTS)] == part]


def _word(rng: np.random.Generator) -> str:
    word = "".join(_of(rng, SYLLABLES) for _ in range(int(rng.integers(1, 4))))
    return word if len(word) > 2 else word + _of(rng, SYLLABLES)


def _filled(form: str, kind: str, rng: np.random.Generator) -> str:
    """A form with its digits, words and ends drawn; a card's last digit is the check digit."""
    while True:
        one = re.sub(r"\{([wct])\}", lambda m: {"w": _word(rng), "c": _word(rng).capitalize(), "t": _of(rng, TOPS)}[m[1]], form)
        one = re.sub("[%&#]", lambda m: str(rng.integers(10)) if m[0] == "#" else ("%x" if m[0] == "%" else "%X") % rng.integers(16), one)
        if kind == "card":
            one = next(one[:-1] + d for d in "0123456789" if luhn(_NOT_DIGIT.sub("", one[:-1] + d)))
        if not kind or _valid(KINDS.index(kind), one):
            return one


def drawn_table(part: str, each: int = 2, contexts: tuple[str, ...] = DRAWN_CONTEXTS, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with their spans: every form of a part ``each`` times, words and digits drawn anew."""
    rng, out = np.random.default_rng(seed), []
    for kind in GRAMMARS:
        for form in drawn_forms(kind, part):
            for _ in range(each):
                before, after = (re.sub(r"\{w\}", lambda _: _word(rng), half) for half in _of(rng, contexts).split("{}"))
                one = _filled(form, kind, rng)
                out.append((before + one + after, [(len(before), len(before) + len(one), kind)] if kind else []))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table() + drawn_table("train"))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, the digest of the base spans, all spans.

    Places are code points, ends exclusive. A span of the field that overlaps a base span
    or an earlier span of its own is left out.

    * null or empty text: no spans; null id: kept; repeated rows: a result row each
    * very long texts are read whole; an empty table: no rows; other columns are not read
    """
    field = field or default_field()
    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    @F.pandas_udf(schema)
    def spans_of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            own = texts.tolist()
            rows = []
            for text, extra in zip(own, field_spans(field, own)):
                base = base_spans(text)
                spans = list(base)
                for s, e, k in sorted(extra):
                    if all(e <= s2 or s >= e2 for s2, e2, _ in spans):
                        spans.append((s, e, k))
                counts = [sum(x[2] == k for x in base) for k in range(4)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    found = keyed(docs, id_col, text_col).select(F.col("id").alias(id_col), spans_of("text").alias("s"))
    return found.select(id_col, "s.*")
