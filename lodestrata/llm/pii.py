"""PII: fixed patterns, and a semi-Markov conditional random field that adds the spans which no fixed pattern has."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import slices

KINDS = ("email", "ip", "card", "phone", "secret", "account", "national_id", "address")
BASE_KINDS = KINDS[:4]
#: Words of an entity at most, as many as the longest account number (34 places) in groups of four has; plain words between two with a trigger which still are
#: looked at together, half of them belonging to either.
LONGEST, GAP = 9, 4
FEATURES = 1 << 13
#: Words that are scored at once.
BLOCK = 512
#: Words, or ends of words, of streets' names.
_STREET = re.compile(r"(?i)(\b(street|st|avenue|ave|road|rd|lane|drive|rue|boulevard|calle|avenida|plaza)|(straße|weg|platz|allee))\b")
#: Names whose values are secrets.
SECRET_KEYS = ("password", "token", "secret", "api_key", "passwd", "pwd", "apikey", "access_key", "private_key", "passphrase")
#: Places of account numbers by country, and where letters stand in their examples (A), in groups of four.
ACCOUNTS = {
    "AT": "99 9999 9999 9999 9999", "BE": "99 9999 9999 9999", "CH": "99 9999 9999 9999 9999 9", "DE": "99 9999 9999 9999 9999 99", "ES": "99 9999 9999 9999 9999 9999",
    "FR": "99 9999 9999 9999 9999 9A99 999", "GB": "99 AAAA 9999 9999 9999 99", "IT": "99 A999 9999 9999 9999 9999 999", "NL": "99 AAAA 9999 9999 99", "PL": "99 9999 9999 9999 9999 9999 9999",
    "PT": "99 9999 9999 9999 9999 9999 9", "SE": "99 9999 9999 9999 9999 9999",
}

_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
#: What any entity holds: a digit, an at sign, what parts a key from its value, or how a key begins.
_TRIGGER = re.compile(r"[0-9@=:]|AKIA|sk-|ghp_")
_NOT_DIGIT = re.compile(r"[^0-9]")
_SECRET = re.compile(r"[=:]|AKIA|sk-|ghp_|[Bb]earer ")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_AGAIN = re.compile(r"(?s)(.)\1+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what the fixed patterns match, leftmost and not overlapping for each kind; failed checks are dropped."""
    out = []
    if "@" in text:
        for run in _RUN.finditer(text):
            at, end = run.start(), run.end()
            while (sign := text.find("@", at, end)) >= 0:
                domain = _DOMAIN.match(text, sign + 1, end) if sign > at else None
                if domain:
                    out.append((at, "email", domain.end()))
                at = domain.end() if domain else sign + 1
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), "phone", m.end()))
    return out


def checked(account: str) -> bool:
    """Whether an account number's check digits are right: the rest, then the first four places, letters as 10 to 35, leaves 1 of 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


class _Kinds(dict):
    """Of each character 9, A or a for a digit, a capital, or another letter; itself for any other."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = found = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return found


_KINDS_OF = _Kinds()


def segment_features(text: str, words: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Features of the whole stretch from word i to before word j, hashed: what none of its words shows by itself is in them."""
    s = text[words[i][0] : words[j - 1][1]].strip(".,;:!?()\"'")
    kinds = s.translate(_KINDS_OF)
    digits, letters = kinds.count("9"), kinds.count("a") + kinds.count("A")
    found = [
        "bias", f"n{j - i}", f"shape{_AGAIN.sub(r'\1', kinds[:60])}", f"d{min(digits, 20)}", f"l{min(letters, 24) // 3}", f"len{min(len(s), 60) // 4}", f"head{s[:4].lower()}", f"plus{s[:1] == '+'}",
        f"at{min(s.count('@'), 2)}", f"dots{min(s.count('.'), 4)}", f"eq{'=' in s}", f"mixed{digits > 2 and letters > 2}", f"before{text[words[i - 1][0] : words[i - 1][1]].lower()[-8:] if i else ''}",
    ]
    if letters:
        found.append(f"street{bool(_STREET.search(s))}{j - i}")
    if "=" in s or ":" in s:
        key = re.split("[=:]", s, maxsplit=1)[0].strip("\"' ").lower()
        found.append("key" + key[-10:])
        found.append(f"known{key.endswith(SECRET_KEYS)}{j - i}")
        found.append(f"valued{bool(re.search('[=:] *[^=: ]', s))}")
    if "earer " in s:
        found.append(f"bearer{s[:6].lower() == 'bearer'}{j - i}{digits > 2}")
    if digits and not letters:
        found.append("groups" + "-".join(str(len(x)) for x in re.findall("[0-9]+", s)))
    if 12 <= digits <= 19:
        found.append(f"luhn{luhn(_NOT_DIGIT.sub('', s))}")
    if digits >= 8 and kinds[:2] == "AA":
        solid = s.replace(" ", "")
        if _ACCOUNT.fullmatch(solid):
            places = ACCOUNTS.get(solid[:2], "").replace(" ", "")
            found.append(f"account{checked(solid)}")
            found.append(f"places{len(solid) - len(places) - 2 if places else 'unknown'}")
    if s.count(".") == 3:
        found.append(f"parts{all(p.isdigit() and int(p[:4]) <= 255 for p in s.split('.'))}")
    return sorted({zlib.crc32(x.encode()) % FEATURES for x in found})


def bar(s: str) -> np.ndarray:
    """0 for each kind that a stretch could be by what it holds at all, a very low score for the others."""
    kinds = s.translate(_KINDS_OF)
    digits = kinds.count("9")
    letters = "a" in kinds or "A" in kinds
    could = ("@" in s, digits >= 4 and s.count(".") >= 3, digits >= 12, digits >= 7, letters and bool(_SECRET.search(s)), digits >= 8 and letters, digits >= 8, digits > 0 and letters and " " in s)
    return np.where(could, 0.0, -1e6)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """Logs of sums of what x has the logs of; along the axis one at least is finite."""
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


class SemiMarkov:
    """Scores of segmentations: for each entity the sum of its whole-span features' weights, for each step one of its pair of labels.
    Label 0 is any one word outside; the others are KINDS, of LONGEST words at most."""

    def __init__(self) -> None:
        self.w = np.zeros((len(KINDS), FEATURES))
        self.t = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def segments(self, text: str, words: list[tuple[int, int]], low: int = 0, high: int | None = None) -> dict[tuple[int, int], tuple[list[int], np.ndarray]]:
        """Features of every stretch that begins at the words from low to before high, all by default; none of what can be of no kind."""
        high, out = len(words) if high is None else high, {}
        for i in range(low, high):
            for j in range(i + 1, min(i + LONGEST, len(words)) + 1):
                barred = bar(text[words[i][0] : words[j - 1][1]])
                out[i, j] = segment_features(text, words, i, j) if barred.max() == 0 else [], barred
        return out

    def _scores(self, segments: dict[tuple[int, int], tuple[list[int], np.ndarray]]) -> dict[tuple[int, int], np.ndarray]:
        sums = np.stack([low for _, low in segments.values()]) if segments else np.zeros((0, len(KINDS)))
        flat, of = _flat([f for f, _ in segments.values()])
        for y in range(len(KINDS)):
            sums[:, y] += np.bincount(of, weights=self.w[y, flat], minlength=len(sums))
        return dict(zip(segments, sums, strict=True))

    @staticmethod
    def _lattice(scores: dict[tuple[int, int], np.ndarray], n: int) -> np.ndarray:
        """Scores by first word, length less one, and kind."""
        out = np.full((n, LONGEST, len(KINDS)), -np.inf)
        if scores:
            at = np.array(list(scores))
            out[at[:, 0], at[:, 1] - at[:, 0] - 1] = np.stack(list(scores.values()))
        return out

    def best(self, text: str, words: np.ndarray | list[tuple[int, int]], block: int = BLOCK) -> list[tuple[int, int, str]]:
        """(first word, end word, kind) of the best segmentation's entities, boundaries and kinds chosen together. Features and scores are made for a block of words at
        a time; of each word before, nothing is held but where the best ways to it came from, two bytes a label."""
        n, k = len(words), len(KINDS) + 1
        size, was = np.zeros((n + 1, k), np.int8), np.zeros((n, k), np.int8)
        lattice, into = np.full((LONGEST + block, LONGEST, k - 1), -np.inf), np.full((LONGEST + block, k), -np.inf)  # of a block and the LONGEST words before
        value = np.full(k, -np.inf)
        value[0] = 0.0
        for low in range(0, n, block):
            high, first = min(low + block, n), max(low - 1, 0)
            near = [(int(a), int(b)) for a, b in words[first : high + LONGEST]]
            fresh = self._lattice(self._scores(self.segments(text, near, low - first, high - first)), high - first)[low - first :]
            lattice[:LONGEST], into[:LONGEST] = lattice[block:], into[block:]
            lattice[LONGEST : LONGEST + high - low] = fresh
            for j in range(low, high):
                steps = value[:, None] + self.t
                was[j], into[LONGEST + j - low] = steps.argmax(axis=0), steps.max(axis=0)
                starts = np.arange(max(0, j + 1 - LONGEST), j + 1)
                here = starts - low + LONGEST
                totals = into[here, 1:] + lattice[here, j - starts]
                pick = totals.argmax(axis=0)
                value = np.append(into[LONGEST + j - low, 0], totals[pick, np.arange(k - 1)])
                size[j + 1, 0], size[j + 1, 1:] = 1, j + 1 - starts[pick]
        j, y, out = n, int(value.argmax()), []
        while j:
            i = j - int(size[j, y])
            if y:
                out.append((i, j, KINDS[y - 1]))
            j, y = i, int(was[i, y])
        return out[::-1]

    def slopes(self, n: int, gold: list[tuple[int, int, str]], segments: dict) -> tuple[float, np.ndarray, list[tuple[list[int], np.ndarray]]]:
        """The log-likelihood of the true segmentation of n words, its slope in t, and those in w as (features, by kind), by sums over all
        segmentations forwards and backwards, under the weights as they are."""
        scores, k = self._scores(segments), len(KINDS) + 1
        lattice = self._lattice(scores, n)
        ahead, into = np.full((n + 1, k), -np.inf), np.empty((n, k))
        behind, onward = np.zeros((n + 1, k)), np.empty((n, k))
        ahead[0, 0] = 0.0
        for j in range(n + 1):
            if j:
                starts = np.arange(max(0, j - LONGEST), j)
                ahead[j, 0] = into[j - 1, 0]
                ahead[j, 1:] = _log_sum(into[starts, 1:] + lattice[starts, j - starts - 1], axis=0)
            if j < n:
                into[j] = _log_sum(ahead[j][:, None] + self.t, axis=0)
        for i in reversed(range(n)):
            ends = np.arange(i + 1, min(i + LONGEST, n) + 1)
            onward[i, 0] = behind[i + 1, 0]
            onward[i, 1:] = _log_sum(lattice[i, ends - i - 1] + behind[ends, 1:], axis=0)
            behind[i] = _log_sum(self.t + onward[i], axis=1)
        whole = _log_sum(ahead[n], axis=0)
        dt = -np.exp(ahead[:-1, :, None] + self.t + onward[:, None, :] - whole).sum(axis=0)
        able = [x for x, (f, _) in segments.items() if f]
        at = np.array(able, np.int64).reshape(-1, 2)
        own = -np.exp(into[at[:, 0], 1:] + lattice[at[:, 0], at[:, 1] - at[:, 0] - 1] + behind[at[:, 1], 1:] - whole)
        dw = [(segments[x][0], slope) for x, slope in zip(able, own, strict=True)]
        total, at, was = -whole, 0, 0
        for i, j, kind in [*gold, (n, n, "")]:
            while at < i:
                total += self.t[was, 0]
                dt[was, 0] += 1
                at, was = at + 1, 0
            if kind:
                y = KINDS.index(kind)
                total += self.t[was, y + 1] + scores[i, j][y]
                dt[was, y + 1] += 1
                dw.append((segments[i, j][0], np.eye(len(KINDS))[y]))
                at, was = j, y + 1
        return float(total), dt, dw

    def learn(self, n: int, gold: list[tuple[int, int, str]], rate: float, segments: dict) -> None:
        """One step up the conditional log-likelihood of the true segmentation."""
        _, dt, dw = self.slopes(n, gold, segments)
        self.t += rate * dt
        if not dw:
            return
        up = rate * np.stack([slope for _, slope in dw])
        steep = np.abs(up).max(axis=1) > rate * 1e-7
        flat, of = _flat([f for (f, _), x in zip(dw, steep, strict=True) if x])
        up = up[steep][of]
        for y in range(len(KINDS)):
            np.add.at(self.w[y], flat, up[:, y])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All entries of some lists, and the number of each one's list."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for f in lists for x in f), np.int64, int(sizes.sum())), np.repeat(np.arange(len(lists)), sizes)


def _example(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A made-up line of words with entities and look-alikes, and where its entities are."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    h = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    word = lambda: "".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9)))
    key = lambda: rng.choice(SECRET_KEYS)
    cap = lambda: word().capitalize()
    pair = lambda k, v: rng.choice((f"{k}={v}", f"{k}={v}", f'{k} = "{v}"', f"{k} = {v}", f"{k}: {v}", f'{k}="{v}"'))

    def card() -> str:
        base = rng.choice("3456") + d(rng.choice((13, 14, 14, 14)))
        full = next(base + c for c in "0123456789" if luhn(base + c))
        return rng.choice((full, " ".join(full[k : k + 4] for k in range(0, len(full), 4)), "-".join(full[k : k + 4] for k in range(0, len(full), 4))))

    def account() -> str:
        country = rng.choice(list(ACCOUNTS))
        rest = "".join(d(1) if c == "9" else rng.choice("ABCDEFGHKLMNPRSTW") for c in ACCOUNTS[country].replace(" ", "")[2:])
        full = country + d(2) + rest
        if rng.random() < 0.8:
            full = next(country + f"{k:02d}" + rest for k in range(2, 99) if checked(country + f"{k:02d}" + rest))
        return full if rng.random() < 0.4 else " ".join(full[k : k + 4] for k in range(0, len(full), 4))

    def mixed(n: int) -> str:
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789/+_-", k=n))

    def named() -> str:
        long = f"{rng.choice(('aws', 'client', 'auth', 'my', 'db', word()))}_{rng.choice(SECRET_KEYS)}"
        return pair(rng.choice((long, long.upper(), f"aws_secret_{rng.choice(SECRET_KEYS)}")), rng.choice((mixed(rng.randint(12, 44)), h(32))))

    def bearer() -> str:
        return rng.choice(("", "", "Authorization: ")) + "Bearer " + rng.choice((mixed(rng.randint(20, 50)) + d(2), ".".join("eyJ" + mixed(rng.randint(12, 40)) for _ in range(3)), h(rng.randint(16, 40)) + d(3)))

    def decoy() -> str:
        base = rng.choice("123456789") + d(14)
        return next(base + c for c in "0123456789" if not luhn(base + c))

    makers = {
        "email": lambda: f"{word()}{rng.choice(('.', '_', ''))}{word()}{rng.choice(('', d(2)))}@{word()}{rng.choice(('', d(1)))}.{rng.choice(('com', 'org', 'example.com', 'de'))}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice((f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", *[f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"] * 5)),
        "secret": lambda: rng.choice((named(), named(), named(), bearer(), bearer(), pair("password", h(rng.randint(8, 24))), pair(key(), h(rng.randint(10, 40))), pair(key(), h(40)), pair(key(), word() + word()), f"AKIA{''.join(rng.choices('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', k=16))}", f"AKIA{''.join(rng.choices('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', k=16))}", f"sk-{h(32)}", f"ghp_{h(36)}", *[f"{key()}={word()}{word()}", f"{key()}={word()}{word()}{word()}"] * 3, f"{key()}={word()}{d(1)}", f"AKIA{''.join(rng.choices('ABCDEFGHIJKLMNOPQRSTUVWXYZ', k=16))}")),
        "account": lambda: rng.choice((account(), account(), account(), account(), account(), f"{rng.choice(('DE', 'FR', 'ES', 'GB', 'NL'))}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}", f"{rng.choice(('DE', 'FR', 'ES', 'IT'))}{d(rng.randint(18, 22))}", f"GB{d(2)}{''.join(rng.choices('ABCDEFGH', k=4))}{d(14)}")),
        "national_id": lambda: rng.choice((f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(8)}-{rng.choice('ABCDEFGHJKLM')}", f"{d(8)}{rng.choice('ABCDEFGHJKLM')}")),
        "address": lambda: rng.choice((f"{rng.randint(1, 9999)} {cap()} {rng.choice(('Street', 'St', 'Avenue', 'Ave', 'Road', 'Rd', 'Lane', 'Drive'))}", f"{cap()}{rng.choice(('straße', 'weg', 'platz', 'allee'))} {rng.randint(1, 250)}", f"{rng.randint(1, 300)} {rng.choice(('rue', 'avenue', 'boulevard'))} {word()}", f"{rng.choice(('Calle', 'Avenida', 'Plaza'))} {cap()} {rng.randint(1, 300)}")),
        "": lambda: rng.choice((d(rng.randint(1, 8)), f"{rng.randint(1, 99)} {cap()}", f"{cap()} {rng.randint(1, 99)}", f"{rng.randint(1, 99)} {word()} {word()}", f"{d(4)}-{d(4)}", f"{word()} = {word()}", f"{word()} = {d(2)}", f"{word()}: {word()}", f"{rng.choice('BC')}{rng.choice('BY')} {d(1)}.{d(1)}", f"{rng.choice(('version', 'Version', 'Copyright', 'page', 'Section', 'Chapter'))} {rng.choice((d(1), d(2), d(4), f'{d(1)}.{d(1)}', f'{d(1)}.{d(1)}. {cap()}', f'{d(4)} {word()}'))}", f"{d(3)} {d(2)} {d(4)}", f"{d(1)}.{d(2)}", f"{d(1)}.{d(1)}", f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", f"{d(2)}:{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", f"{d(3)},{d(3)}", word() + d(2), f"{word()}={d(2)}", "@" + word(), f"{d(2)}%", f"${d(3)}", f"{h(6)}", d(13), decoy(), decoy(), f"{word()}={word()}", f"{word()}={word()}{word()}", f"{word()}:", f"{word()}:{word()}", f"{word()}: {cap()} {word()}", f"bearer {word()} {d(2)}", f"{cap()[:2].upper()}{d(2)} {word()} {d(4)}", " ".join(d(rng.randint(1, 4)) for _ in range(rng.randint(2, 9))), word() + word())),
    }
    words, gold = [], []
    for _ in range(rng.randint(2, 5)):
        words += [word() for _ in range(rng.randint(0, 2))]
        kind = rng.choice([*makers, ""])
        parts = makers[kind]().split(" ")
        if kind:
            gold.append((len(words), len(words) + len(parts), kind))
        if rng.random() < 0.2:
            parts[-1] += rng.choice(".,")
        words += parts
    return " ".join(words), gold


@lru_cache
def train(examples: int = 1200, epochs: int = 5, seed: int = 11) -> SemiMarkov:
    """A model fitted to made-up lines; it needs no texts, so it is the same for every corpus, and made once in a process."""
    rng, model, made = random.Random(seed), SemiMarkov(), []
    for _ in range(examples):
        text, gold = _example(rng)
        words = [m.span() for m in _WORD.finditer(text)]
        made.append((text, words, gold, model.segments(text, words)))
    for epoch in range(epochs):
        rng.shuffle(made)
        for _, words, gold, segments in made:
            model.learn(len(words), gold, 0.3 / (1 + epoch), segments)
    return model


def added_spans(text: str, base: list[tuple[int, str, int]], model: SemiMarkov) -> list[tuple[int, str, int]]:
    """Entities of the best segmentations that don't overlap a base span. Only stretches with a trigger outside base spans
    are segmented; words elsewhere can't be part of an entity, so they are outside in any best segmentation."""
    taken = [(start, end) for start, _, end in sorted(base)]
    triggers = np.fromiter((m.start() for m in _TRIGGER.finditer(text)), np.int64)
    lone = np.fromiter(_outside(triggers, taken), np.int64)
    if not len(lone):
        return []
    words = np.fromiter((x for m in _WORD.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
    hot, asked = np.zeros(len(words), bool), np.zeros(len(words), bool)
    hot[np.searchsorted(words[:, 1], triggers, side="right")] = True
    asked[np.searchsorted(words[:, 1], lone, side="right")] = True
    out, places = [], np.flatnonzero(hot)
    for group in np.split(places, np.flatnonzero(np.diff(places) > GAP + 1) + 1):
        if not asked[group].any():
            continue
        low, high = max(int(group[0]) - GAP // 2, 0), min(int(group[-1]) + 1 + GAP // 2, len(words))
        own = words[low:high]
        for i, j, kind in model.best(text, own):
            a, b = int(own[i][0]), int(own[j - 1][1])
            while b > a and text[b - 1] in ".,;:!?":
                b -= 1
            if b > a and _TRIGGER.search(text, a, b) and not any(x < b and a < y for x, y in taken):
                out.append((a, kind, b))
    return out


def _outside(triggers: np.ndarray, taken: list[tuple[int, int]]) -> Iterator[int]:
    """Those of sorted places that are in no base span."""
    at = 0
    for place in triggers:
        while at < len(taken) and taken[at][1] <= place:
            at += 1
        if not any(a <= place < b for a, b in taken[at : at + 3]):
            yield place


def _find(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            found: list[list[dict]] = []
            texts = batch["text"]
            for low, high, _, _ in slices(texts):
                for k in range(low, high):
                    spans = []
                    text = texts[k].as_py() or ""
                    if _TRIGGER.search(text):
                        base = base_spans(text)
                        extra = added_spans(text, base, crf)
                        order = lambda x: (x[0], KINDS.index(x[1]), x[2])
                        spans = [{"kind": kind, "start": a, "end": b, "base": is_base} for (a, kind, b), is_base in sorted([(x, True) for x in base] + [(x, False) for x in extra], key=lambda y: order(y[0]))]
                    found.append(spans)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, kind)], ["doc_id", "spans"])

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end, base) for each row, by start and then by KINDS; places are code points, ends exclusive.

    Base spans are what the fixed patterns match; the random field adds others, such as secrets and numbers written in other
    ways, where they don't overlap base ones: besides secrets, accounts, national ids and addresses. No rows give no rows. A null or empty text has no spans. Repeated rows and a null doc_id are rows like any
    other; other columns are not looked at. No row needs another, and a long text is scanned in time linear in its length, however many numbers it
    has, with some thirty bytes a word besides the text and its spans.
    """
    model = docs.sparkSession.sparkContext.broadcast(train())
    return docs.select("doc_id", "text").mapInArrow(_find(model), "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of what find_pii returns, and n_spans, the number of all spans."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return result.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
