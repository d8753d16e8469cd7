"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def line_dedup(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = {key: (text or "").split("\n") for key, text in rows}
    holders = defaultdict(set)
    for key, own in lines.items():
        for line in own:
            holders[line.strip(SPACES).translate(lower)].add(key)
    out = {}
    for key, own in lines.items():
        def drops(line):
            name = line.strip(SPACES).translate(lower)
            return len(name) >= 20 and len(holders[name]) >= 3 and key != max(holders[name])
        kept = [line for line in own if not drops(line)]
        out[key] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


def quality_counts(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    count, covered = Counter(windows), set()
    for at, window in enumerate(windows):
        if count[window] > 1:
            covered |= {at, at + 1, at + 2}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def shingles(text):
    words = WORD.findall(text or "")
    return set(zip(*(words[at:] for at in range(5)))) if len(words) >= 5 else ({tuple(words)} if words else set())


def jaccard_classes(rows):
    """Class and number of links by comparing all pairs."""
    sets = {key: shingles(text) for key, text in rows}
    parent, links = {key: key for key in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for at, a in enumerate(keys):
        for b in keys[at + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {key: (find(key), links[key]) for key in keys}


def suffix_dedup(rows, length=100):
    seen, out = set(), {}
    for key, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            part = data[at : at + length]
            if part in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for at, g in enumerate(gone) if g and not (at and gone[at - 1]))
        out[key] = (len(data), sum(gone), spans, kept)
    return out


def edited(rows):
    ordered = sorted(rows, reverse=True)
    out = {}
    for at, (key, text) in enumerate(ordered):
        text, following = text or "", ordered[(at + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        out[key] = text[: len(text) - half] + following[:half]
    return out
