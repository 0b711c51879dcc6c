"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import html
import re

import regex

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def quality_base(text):
    text = text or ""
    w = WORD.findall(text)
    counts = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if counts[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def near_duplicates(rows):
    """rows (doc_id, text) with different ids -> {doc_id: (class_id, n_links, n_copies)}."""
    nodes = collections.defaultdict(list)
    for i, t in rows:
        nodes[shingles(t)].append(i)
    out = {i: (i, 0, 0) for i in nodes.pop(frozenset(), [])}
    sets = list(nodes)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.defaultdict(set)
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                links[a].add(b)
                links[b].add(a)
                root[max(find(a), find(b))] = min(find(a), find(b))
    classes = collections.defaultdict(list)
    for a, s in enumerate(sets):
        classes[find(a)] += nodes[s]
    for a, s in enumerate(sets):
        n = sum(len(nodes[sets[b]]) for b in links[a]) + len(nodes[s]) - 1
        out |= {i: (min(classes[find(a)]), n, len(nodes[s]) - 1) for i in nodes[s]}
    return out


def contained(documents, items, least=0.8):
    out = set()
    for i, t in documents:
        own = shingles(t)
        for k, x in items:
            s = shingles(x)
            if s and len(s & own) >= least * len(s):
                out.add((i, k, len(s & own), len(s)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal_data(text):
    """(start, end, kind) by start, then kind as listed."""
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    out = []
    for rank, (kind, pattern) in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            holds = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }
            if holds[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def removed(texts, length):
    """Per text (bytes): n_bytes, n_removed, n_spans, sha256 of what is left."""
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


TOKEN = regex.compile("[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\x20\x09-\x0d]")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _beside(before, after):
    joints = " \t\n\x0b\x0c\r()[]-"
    return [t.lower() for t in TOKEN.findall(before.rstrip(joints))[-3:]], [t.lower() for t in TOKEN.findall(after.lstrip(joints))[:3]]


def _instances(text):
    """(start, end, value, kind or None, tokens before, tokens after) of base spans and of runs of other words with a digit or an @."""
    held = {(a, b, k) for a, b, k in personal_data(text)}
    out = []
    for kind, pattern in BASE.items():
        found = [m.span() for m in re.finditer(pattern, text)]
        edges = [0, *(x for s in found for x in s), len(text)]
        for n, (a, b) in enumerate(found):
            if (a, b, kind) in held:
                out.append((a, b, text[a:b], kind, *_beside(text[edges[2 * n] : a], text[b : edges[2 * n + 3]])))
    words = [m for m in WORD.finditer(text) if re.search("[0-9@]", m[0])]
    runs = []
    for n, m in enumerate(words):
        lead = regex.match(r"[^\p{L}\p{N}]*+(?:[\p{L}_.-]++[=:]++[^\p{L}\p{N}]*+)?+", m[0])[0]
        value = regex.sub(r"[^\p{L}\p{N}]+$", "", m[0][len(lead) :])
        if not value or any(a < m.end() and b > m.start() for a, b, _ in held):
            continue
        before, after = text[words[n - 1].end() if n else 0 : m.start()], text[m.end() : words[n + 1].start() if n + 1 < len(words) else len(text)]
        digits = bool(re.search("[0-9]", m[0])) and "@" not in m[0]
        start = m.start() + len(lead)
        left, right = _beside(before + lead, m[0][len(lead) + len(value) :] + after)
        joins = digits and before and re.fullmatch(r" [ ()\[\]-]*", before + lead)
        if joins and runs and runs[-1]["at"] == n - 1 and runs[-1]["open"]:
            runs[-1] |= {"end": start + len(value), "value": f"{runs[-1]['value']} {value}", "right": right}
        else:
            runs.append({"start": start, "end": start + len(value), "value": value, "left": left, "right": right})
        runs[-1] |= {"at": n, "open": digits and bool(regex.search(r"[\p{L}\p{N}][()\[\]-]*$", m[0]))}
    return out + [(r["start"], r["end"], r["value"], None, r["left"], r["right"]) for r in runs]


def bootstrapped(texts, rounds=5, support=5, least=0.5, confidence=0.8):
    """Per text the set of (kind, start, end) that the bootstrap adds."""
    totals = collections.Counter()
    for text in texts:
        t = [x.lower() for x in TOKEN.findall(text or "")]
        totals.update(" ".join(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1))
    everything = [(row, *x) for row, text in enumerate(texts) for x in _instances(text or "")]
    found = {}
    for _ in range(rounds):
        values, n = collections.defaultdict(set), collections.Counter()
        patterns = []
        for row, a, b, value, kind, left, right in everything:
            own = [("left", " ".join(left[-k:])) for k in range(1, len(left) + 1)] + [("right", " ".join(right[:k])) for k in range(1, len(right) + 1)]
            patterns.append(own)
            secret = "secret" if regex.fullmatch("[A-Za-z0-9]{20,}", value) and regex.match("(?:[0-9]*+[A-Za-z]++[0-9]++){4}", value) else None
            if known := kind or found.get((row, a, b)) or secret:
                for p in own:
                    values[p, known].add(value)
                    n[p, known] += 1
        strong = collections.defaultdict(dict)
        for (p, kind), v in values.items():
            score = n[p, kind] / max(totals[p[1]], n[p, kind]) if totals[p[1]] else 0
            if len(v) >= support and score >= least:
                strong[p][kind] = score
        now = {}
        for (row, a, b, _, kind, _, _), own in zip(everything, patterns, strict=True):
            scores = {}
            for k in {k for p in own for k in strong[p]} if kind is None else ():
                best = {side: max([strong[p].get(k, 0) for p in own if p[0] == side], default=0) for side in ("left", "right")}
                scores[k] = 1 - (1 - best["left"]) * (1 - best["right"])
            if scores and max(scores.values()) >= confidence:
                now[row, a, b] = max((s, k) for k, s in scores.items())[1]
        if now == found:
            break
        found = now
    return [{(k, a, b) for (row, a, b), k in found.items() if row == i} for i in range(len(texts))]


def main_text(page):
    """The text of a page whose article is an article element, by cutting strings."""
    text = re.search("<article>(.*?)</article>", page or "", re.S)
    if not text:
        return ""
    text = re.sub("<(script|style|form|aside|nav|footer)\\b.*?</\\1>|<!--.*?-->", "\0", text[1], flags=re.S)
    text = re.sub('<div class="(?:ad|comments?)">.*?</div>', "\0", text, flags=re.S)
    text = re.sub("</?(?:p|br|h[1-6]|div|ul|ol|li|table|tr|td|th|blockquote|pre|section|header)\\b[^>]*>", "\0", text)
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in text.split("\0"))
    return "\n".join(x for x in blocks if x)
