"""Plain Python versions of the operators, written from their contracts."""

import hashlib
import re

import xxhash

UPPER = {c: c + 32 for c in range(65, 91)}
WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(kind, m.start(), m.end()) for kind, p, ok in rules for m in re.finditer(p, text) if ok(m.group())]


def repeats(docs: list[tuple[int, str]], length: int = 100) -> dict:
    """doc_id -> (n_bytes, n_removed, n_spans, kept); docs in order."""
    seen, out = set(), {}
    for doc_id, text in docs:
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc_id] = len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone, strict=True) if not g)
    return out


def fingerprint(text: str, width: int = 4) -> int:
    words = WORDS.findall(text.translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(fps: dict[int, int], distance: int = 4) -> dict[int, int]:
    """id -> smallest id reachable over pairs within the distance."""
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def dedup(docs: list[tuple[int, str]], min_chars: int = 20, min_docs: int = 3) -> dict:
    """doc_id -> (n_lines, n_dropped, text)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders: dict[str, set] = {}
    for doc_id, text in docs:
        for line in text.split("\n"):
            holders.setdefault(key(line), set()).add(doc_id)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = {}
    for doc_id, text in docs:
        lines = text.split("\n")
        kept = [x for x in lines if gone.get(key(x), doc_id) == doc_id]
        out[doc_id] = len(lines), len(lines) - len(kept), "\n".join(kept)
    return out


# Spot signatures, word by word: the common words that start a chain, and those that are no content.
ANCHORS = "the a an is was that it le la une est qui der die das ist ein el los una es que".split()
COMMON = ANCHORS + """of and to in for on with by as at be are this from or les de des du un et en dans par pour sur avec pas au und zu den dem von mit auf für nicht sich auch
    im eine y en del por con para no su al lo se""".split()


def spots(text: str, chain: int = 2) -> set:
    """The chains themselves: (anchor, content words after it); the start of the text is an anchor without a name."""
    words = re.findall(r"\w+", text.lower())
    if not any(w not in COMMON for w in words):
        return {tuple(words)} if words else set()
    found = set()
    for i in range(-1, len(words)):
        if i >= 0 and words[i] not in ANCHORS:
            continue
        after = [w for w in words[i + 1 :] if w not in COMMON][:chain]
        if after:
            found.add(("" if i < 0 else words[i], *after))
    return found


def alike(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def linked(sets: dict, floor: float) -> dict:
    """id -> smallest id reachable over pairs at least ``floor`` alike."""
    ids, label = sorted(sets), {i: i for i in sets}
    pairs = [(i, j) for n, i in enumerate(ids) for j in ids[n + 1 :] if min(len(sets[i]), len(sets[j])) >= floor * max(len(sets[i]), len(sets[j])) and alike(sets[i], sets[j]) >= floor]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            least = min(label[i], label[j])
            changed = changed or label[i] != least or label[j] != least
            label[i] = label[j] = least
    return label
