"""Plain statements of the contracts, one text or table at a time, to hold the operators against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256)"""
    text = text or ""
    letters = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    words = "|".join(map(letters, ("password", "passwd", "secret", "token", "api_?key")))
    rules = (
        ("assign", f"({words})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m)]
    counts = Counter(f[2] for f in found)
    return counts["assign"], counts["access"], counts["hex"], sha(",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(found)))


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), len(words) < 10 or 100 * len(cover) > 20 * len(words)


def targets(sizes: dict, weights=(5, 2, 1), most=3):
    """Target of each source, from its size; None is the null source."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    rest = total
    while free:
        share = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / share > most * sizes[s]}
        if not over:
            out |= {s: rest * weight[s] / share for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
        rest -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def fingerprint(text, k=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=3):
    """rows: (doc_id, fingerprint). Smallest id reachable, for each row."""
    ids = defaultdict(list)
    for d, f in rows:
        ids[f].append(d)
    fps, out = set(ids), {}
    while fps:
        group, todo = set(), [fps.pop()]
        while todo:
            f = todo.pop()
            group.add(f)
            near = {g for g in fps if (f ^ g).bit_count() <= radius}
            fps -= near
            todo += near
        known = [d for f in group for d in ids[f] if d is not None]
        out |= dict.fromkeys(group, min(known, default=None))
    return [(d, f"{f:016x}", out[f]) for d, f in rows]


def substring(rows, length=35):
    """rows: (doc_id, text). (doc_id, n_words, n_removed, kept_sha256)"""
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((d, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def chats(rows):
    """rows: (conv_id, turn, role, text). (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256)"""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss)))
    return out


def runs(words):
    """(start, length, period) of every periodic run: all lags, all stretches, all smaller periods."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(doc_id, text):
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)"""
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = sha("".join(f"{s},{length},{q}\n" for s, length, q in found))
    kept = sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, told, kept)


def alignment(rows, encode_a, bytes_a, encode_b, bytes_b):
    """rows: (doc_id, text). (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256); ``encode``: ids of a text, ``bytes``: of an id."""
    found, seen = [], Counter()
    for d, text in rows:
        a, b = (encode_a(" " + text), encode_b(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
            a, b = [], []
        spans = []
        for ids, spell in ((a, bytes_a), (b, bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at := at + len(spell(i)), i))
            spans.append(own)
        links, k = [], 0
        for s, e, i in spans[0]:
            while k and spans[1][k][0] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, heads = [], [0, 0]
        for c in cuts:
            sides = []
            for side, own in enumerate(spans):
                begin = heads[side]
                while heads[side] < len(own) and own[heads[side]][1] <= c:
                    heads[side] += 1
                sides.append(",".join(str(i) for _, _, i in own[begin : heads[side]]))
            groups.append("|".join(sides))
        seen.update(links)
        found.append((d, len(a), len(b), len(cuts), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, j), n in seen.items():
        most[j] = max(most[j], n)
    return [(d, na, nb, n, len(ls), sum(seen[x] == most[x[1]] for x in ls), sum(seen[x] for x in ls), sha(g) if g else "") for d, na, nb, n, ls, g in found]


def licenses(text):
    """(n_words, n_base, first_word, last_word, base_labels)"""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    at = [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in at}))
