"""Plain versions of the pipeline's stages."""

import re

from gridmill.llm.common import WORD


def base_by_hand(text):
    """Whether a text fails the base of the quality rules."""
    words = re.findall(WORD, text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words) < 20 or 100 * len(covered) > 30 * len(words)


def lines_by_hand(docs, span=3):
    """(id, text) without later occurrences of repeated windows of lines; ids are distinct."""
    first, gone = {}, set()
    for key, text in sorted(docs):
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if re.search(WORD, x)]
        for at in range(len(lines) - span + 1):
            window = tuple(x for _, x in lines[at : at + span])
            where = first.setdefault(window, (key, at))
            if where != (key, at):
                gone |= {(key, lines[i][0]) for i in range(max(at, where[1] + span) if where[0] == key else at, at + span)}
    return [(k, "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone)) for k, t in docs]


def group_heads(docs, n=5, threshold=0.8):
    """The ids that stay when each group of similar documents keeps its first."""
    def grams(text):
        words = re.findall(WORD, text)
        return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()

    sets = {k: grams(t) for k, t in docs}
    head = {k: k for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(head[a], head[b])
            changed |= (head[a], head[b]) != (low, low)
            head[a] = head[b] = low
    return sorted(k for k, h in head.items() if k == h)
