"""Plain counterparts of the operators: slow, single-process, written from the contracts alone."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import product

import regex


def shingles(text: str | None, n: int) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def components(docs: list[tuple], n: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    """doc_id: size of its set, smallest id that links reach. Ids are distinct here."""
    sets = {i: shingles(t, n) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and inter * den >= num * (len(sets[a]) + len(sets[b]) - inter):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def repeats(docs: list[tuple], length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    """doc_id: bytes, removed bytes, runs, SHA-256 of what stays."""
    coded = sorted((i, (t or "").encode()) for i, t in docs if i is not None)
    first: dict[bytes, int] = {}
    for i, b in coded:
        for at in range(len(b) - length + 1):
            first.setdefault(b[at : at + length], i)
    out = {}
    for i, b in coded:
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if first[b[at : at + length]] < i:
                gone[at : at + length] = b"\x01" * length
        stay = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(stay).hexdigest())
    return out


def luhn(digits: str) -> bool:
    doubled = [int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    )
    found = [(m.start(), k, kind, m.end()) for k, (kind, rule, test) in enumerate(rules) for m in re.finditer(rule, text) if test(m[0])]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


UNITS = "kg g mg lb lbs oz km m cm mm mi miles mile ft feet inches l ml hours hour minutes minute seconds second days day weeks week months month years year dollars dollar euros euro cents percent".split()


def template(text: str) -> tuple[list[set[str]], list[str], list[str]]:
    """Of every word: its readings, what it is ("number", "unit", "cap" or "word"), and the word in lower case."""
    tokens = list(regex.finditer(r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+", text))
    readings, kinds, last_end = [], [], 0
    for m in tokens:
        w = m[0]
        if regex.match(r"\p{N}", w):
            kinds.append("number")
        elif kinds and kinds[-1] == "number" and not regex.match(r"\p{Lu}\p{Ll}", w) and w.lower() in UNITS and not text[last_end : m.start()].strip():
            kinds.append("unit")
        else:
            kinds.append("cap" if regex.match(r"\p{Lu}\p{Ll}", w) else "word")
        own = {"number": {"<number>"}, "unit": {"<unit>"}, "cap": {w.lower(), "<name>"}, "word": {w.lower()}}
        readings.append(own[kinds[-1]])
        last_end = m.end()
    return readings, kinds, [m[0].lower() for m in tokens]


TYPED = {"<number>", "<unit>", "<name>"}


def leaks(docs: list[tuple], items: list[tuple], window: int = 5, coverage: float = 0.8, plain: int = 3, passage: int = 13) -> set[tuple[int, int]]:
    """Pairs by the rules as stated: every shift of every item is tried in every text."""

    def forms(readings: list[set[str]], at: int) -> set[tuple]:
        return {w for w in product(*readings[at : at + window]) if w.count("<name>") <= window - plain}

    index, of = defaultdict(set), {}
    for item, text in items:
        readings, kinds, words = template(text or "")
        if not words:
            continue
        if kinds[0] in ("word", "cap"):
            readings[0], kinds[0] = {words[0], "<name>"}, "cap"
        own = {at: {w for w in forms(readings, at) if len(set(w) - TYPED) >= plain} for at in range(len(words) - window + 1)}
        lower = {w for w, k in zip(words, kinds, strict=True) if k == "word"}
        slots = {at: (k, w) for at, (k, w) in enumerate(zip(kinds, words, strict=True)) if k in ("number", "unit") or (k == "cap" and w not in lower)}
        reach = {at + i for at, w in own.items() if w for i in range(window)}
        of[item] = words, slots, reach
        for at, found in own.items():
            for w in found:
                index[w].add((item, at))
    out = set()
    for doc, text in docs:
        if doc is None or text is None:
            continue
        readings, _, words = template(text)
        met: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for at in range(len(words) - window + 1):
            for w in forms(readings, at):
                for item, item_at in index.get(w, ()):
                    met[item][at - item_at] |= set(range(item_at, item_at + window))

        def fits(held: dict[int, int], slots: dict[int, tuple]) -> bool:
            told = defaultdict(set)
            for at, shift in held.items():
                if at in slots:
                    told[slots[at]].add(words[at + shift])  # noqa: B023
            return all(len(v) == 1 for v in told.values())

        for item, (item_words, slots, reach) in of.items():
            if not reach:
                n = len(item_words)
                if any(words[at : at + n] == item_words for at in range(len(words) - n + 1)):
                    out.add((doc, item))
                continue
            drift = max(1, int((1 - coverage) * len(item_words) + 1e-9))
            for shift, covered in met.get(item, {}).items():
                near: dict[int, int] = {}
                for s in sorted(met[item], key=lambda s: (abs(s - shift), s)):  # noqa: B023
                    if abs(s - shift) <= drift:
                        for at in met[item][s]:
                            near.setdefault(at, s)
                whole = [h for h in (dict.fromkeys(covered, shift), near) if len(h) >= coverage * len(reach)]
                runs = [set(range(a, z + 1)) for a in covered for z in covered if a - 1 not in covered and z + 1 not in covered and z - a + 1 >= passage and covered >= set(range(a, z + 1))]
                if any(fits(h, slots) for h in [*whole, *(dict.fromkeys(r, shift) for r in runs)]):
                    out.add((doc, item))
    return out
