"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingle_set(text: str | None, size: int) -> set[tuple]:
    w = words(text, lower=True)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(texts: dict[int, str | None], size: int, percent: int) -> dict[int, int]:
    sets = {k: shingle_set(t, size) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def without_repeats(texts: dict[int, str | None], size: int) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    out = {}
    for k in sorted(texts):
        w = words(texts[k])
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first.setdefault(tuple(w[i:i + size]), k) < k:
                gone[i:i + size] = [True] * size
        out[k] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    return out


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, words in repeated five-word windows."""
    w = words(text)
    lines = Counter(x for x in (text or "").split("\n") if words(x))
    grams = defaultdict(list)
    for i in range(len(w) - 4):
        grams[tuple(w[i:i + 5])].append(i)
    marked = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), sum(n - 1 for n in lines.values()), len(marked)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def personal(text: str) -> list[tuple[int, int, int]]:
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def periodic_runs(w: list[str]) -> list[tuple[int, int, int]]:
    """Start, length and period of every stretch with that smallest period that cannot grow, at least 6 words and 4 periods long."""
    stretches: dict[tuple[int, int], int] = {}
    for p in range(1, len(w) // 4 + 1):
        start = 0
        while start + p < len(w):
            end = start + p
            while end < len(w) and w[end] == w[end - p]:
                end += 1
            if end - start >= max(6, 4 * p):
                stretches.setdefault((start, end), p)
            start = max(start + 1, end - p + 1)
    return sorted((a, b - a, p) for (a, b), p in stretches.items())


def collapsed(w: list[str]) -> str:
    gone = {i for a, n, p in periodic_runs(w) for i in range(a + p, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


# --- pages: a tree is [tag, class, items], an item a text or a tree; block elements hold texts, inline elements and blocks -----------


INLINE = {"b", "a", "span", "label"}
START = {"article": 25, "main": 20, "section": 5, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "body": 0}


def page_html(tree) -> str:
    tag, name, items = tree
    inner = "".join(x if isinstance(x, str) else page_html(x) for x in items)
    return f'<{tag} class="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"


def page_text(tree) -> str:
    """Every block climbs to the root on its own; all rules are asked anew of every element."""
    root = ["html", "", [tree]]
    parents = {}

    def walk(node):
        yield node
        for x in node[2]:
            if not isinstance(x, str):
                parents[id(x)] = node
                yield from walk(x)

    nodes = list(walk(root))
    up = lambda n: [n, *up(parents[id(n)])] if id(n) in parents else [n]
    words_of = lambda n: [w for x in n[2] for w in ([len(x.strip())] if isinstance(x, str) else words_of(x) if x[0] not in ("label", "button") and not plain_junk(x) else [])]

    def plain_junk(n):
        return n[0] in ("nav", "footer", "aside", "button") or (n[1] in ("sidebar", "comments") and n[0] not in ("body", "html", "article", "main"))

    def junk(n):
        holds = any(x[0] in ("h1", "h2") for x in list(walk(n))[1:])
        in_article = any(x[0] in ("article", "main") for x in up(n)[1:])
        if n[0] == "header":
            return plain_junk(n) or not (holds and in_article)
        if n[0] == "form":
            return plain_junk(n) or 2 * sum(words_of(n)) <= sum(words_of(root))
        return plain_junk(n)

    blocks, parts = [], []

    def end(owner):
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            blocks.append((owner, text, sum(len(t.strip()) for t, linked in parts if linked)))
        parts.clear()

    def read(node, owner, link):
        for x in node[2]:
            if isinstance(x, str):
                parts.append((x, link))
            elif x[0] in INLINE:
                if not junk(x):
                    read(x, owner, link or x[0] == "a")
            else:
                end(owner)
                if not junk(x):
                    read(x, x, link)
                    end(x)

    read(root, root, False)
    end(root)
    if not blocks:
        return ""
    heading = lambda n: n[0] in ("h1", "h2", "h3")
    under = lambda n: [b for b in blocks if any(x is n for x in up(b[0]))]
    chars, links = (lambda n: sum(len(b[1]) for b in under(n))), (lambda n: sum(b[2] for b in under(n)))
    points, first, depth = {}, {}, {}
    for i, (owner, text, linked) in enumerate(blocks):
        if linked > len(text) / 2 or heading(owner):
            continue
        node = owner if owner[0] in START else parents.get(id(owner), owner)
        for k, x in enumerate(up(node)):
            points[id(x)] = points.get(id(x), 0) + (1 + text.count(",") + min(len(text) / 100, 3)) / 2**k
            first.setdefault(id(x), i)
            depth[id(x)] = len(up(x))
    score = {k: (p + START.get(n[0], -3) + 10 * (n[1] == "content")) * (1 - min(1, links(n) / max(1, chars(n)))) for n in nodes for k, p in points.items() if k == id(n)}
    by_id = {id(n): n for n in nodes}
    best = by_id[max(score, key=lambda k: (round(score[k], 9), -first[k], depth[k]))] if score else root
    low = [x for x in up(best) if 3 * links(x) <= chars(x)]
    marked = [x for x in low if x[0] == "article"] or [x for x in low if x[0] == "main"] or [x for x in low if x[1] == "content" and x[0] not in INLINE and x[0] not in ("body", "html")]
    best = marked[-1] if marked else best
    kept = [best]
    if id(best) in parents and score:
        for x in parents[id(best)][2]:
            if not isinstance(x, str) and x is not best and x[0] not in INLINE and not junk(x) and chars(x):
                prose = x[0] == "p" and chars(x) > 80 and links(x) < 0.25 * chars(x)
                if heading(x) or prose or (x[0] == best[0] and score.get(id(x), 0) >= max(10, 0.2 * score.get(id(best), 0))):
                    kept.append(x)
    return "\n".join(text for owner, text, _ in blocks if any(x is k for x in up(owner) for k in kept))


# --- benchmark items: every window of every reading is compared with every other, word by word -------------------------------------


def slots_of(text: str, units: set[str]) -> list[dict]:
    """Words with value, code, name reading, and whether they are a slot; ASCII texts."""
    out: list[dict] = []
    for m in WORD.finditer(text):
        core = re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", m[0]) or m[0]
        number = core[0].isdigit() and sum(c.isalpha() for c in core) <= 3
        unit = bool(out) and out[-1]["number"] and core.lower() in units
        opening = not out or out[-1]["raw"][-1] in ".!?:" or text[m.start() - 1] == "\n"
        capital = len(core) > 1 and core[0].isupper() and core[1].isalpha() and not core[1].isupper()
        kind = "#" if number else "unit" if unit else "name" if capital and not opening else None
        opens = capital and opening and not number and not unit
        value = core.lower()
        out.append({"raw": m[0], "number": number, "value": value, "code": kind or "=" + value, "kind": kind, "opens": opens,
                    "named": "name" if opens else kind or "=" + value})
    return out


def leak(doc: str, item: str, units: set[str], window: int, literals: int, run: int, share: float, short: int, shift: int, partings: int):
    """Matched words, item words, slots, changed slots of the longest passage that counts, or None."""
    d, b = slots_of(doc, units), slots_of(item, units)
    size = min(window, len(b))
    hits = set()
    for w in range(len(d) - size + 1) if size else ():
        for p in range(len(b) - size + 1):
            x, y = d[w:w + size], b[p:p + size]
            least = min(literals, size)
            plain = lambda z: sum(s["kind"] is None for s in z)
            spare = lambda z: plain(z) - sum(s["opens"] for s in z)
            same = lambda name: [s[name] for s in x] == [s[name] for s in y]  # noqa: E731, B023
            if same("value") or size >= short and (same("code") and plain(x) >= least or same("named") and spare(x) >= least and spare(y) >= least and any(s["opens"] for s in x) and any(s["opens"] for s in y)):
                hits.add((w - p, p))
    groups: list[list[int]] = []
    for k in sorted({k for k, _ in hits}):
        if groups and k - groups[-1][-1] <= shift:
            groups[-1].append(k)
        else:
            groups.append([k])
    best = None
    for group in groups:
        cover = {k: sorted({p + j for s, p in hits if s == k for j in range(size)}) for k in group}
        pairs: list[tuple[int, int]] = []
        for k in sorted(group, key=lambda k: (-len(cover[k]), k)):
            pairs = sorted(pairs + [(p, p + k) for p in cover[k] if all((a - p) * (c - p - k) > 0 for a, c in pairs)])
        found = counted(pairs, d, b, run, share, shift, partings)
        if found and (best is None or found[0] > best[0]):
            best = found
    return best


def counted(pairs, d, b, run, share, shift, partings):
    if not pairs:
        return None
    longest = now = 1
    for (p, w), (q, v) in zip(pairs, pairs[1:], strict=False):
        joined = (q - p == v - w == 1) or (q - p != v - w and max(q - p, v - w) <= shift + 1)
        now = now + 1 if joined else 1
        longest = max(longest, now)
    if longest < min(run, len(b)) and len(pairs) < share * len(b):
        return None
    x = [(b[p], d[w]) for p, w in pairs]
    changed = [s["value"] != t["value"] for s, t in x]
    slots = sum(c or s["kind"] is not None for (s, _), c in zip(x, changed, strict=True))

    def parts(on):
        values = {(s["value"], t["value"]) for s, t in x if on(s) and on(t)}
        return len(values) - len({v for v, _ in values})

    numbers = {(s["value"], t["value"]) for s, t in x if s["kind"] is not None and t["kind"] == "#"}
    if parts(lambda s: s["named"] == "name") or parts(lambda s: s["kind"] == "unit") or len(numbers) - len({v for v, _ in numbers}) > partings:
        opening = [c and (s["kind"] is None or t["kind"] is None) for (s, t), c in zip(x, changed, strict=True)]
        if any(opening):
            return counted([pw for pw, o in zip(pairs, opening, strict=True) if not o], d, b, run, share, shift, partings)
        most = now = 0
        for i, (s, _) in enumerate(x):
            if i and not (not changed[i] and not changed[i - 1] and pairs[i][0] - pairs[i - 1][0] == pairs[i][1] - pairs[i - 1][1] == 1):
                now = 0
            now += s["kind"] is None and not changed[i]
            most = max(most, now)
        if most < run:
            return None
    return len(pairs), len(b), slots, sum(changed)
