"""Plain-Python answers that the operators must give."""

import collections
import hashlib
import re

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"


def rows(name, *columns, sf=SF):
    table = pq.read_table(f"{sf}/{name}.parquet")
    return list(zip(*[table.column(c).to_pylist() for c in columns], strict=True))


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def repetition(text):
    words, seen, again = spaced(text), set(), 0
    for line in (text or "").split("\n"):
        again += bool(spaced(line)) and line in seen
        seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = collections.Counter(windows)
    inside = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside)


def components(docs):
    """(doc_id, n_shingles, component_id) of rows with ids that differ."""
    sets, root, at = [], list(range(len(docs))), collections.defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for _, text in docs:
        words = spaced(lower(text))
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    for i, a in enumerate(sets):
        for j, n in collections.Counter(j for x in a for j in at[x]).items():
            if 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in a:
            at[x].append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)}


def contaminated(docs, items):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows, out = collections.defaultdict(set), set()
    for item, text in items:
        words = alnum(text)
        size = min(13, len(words))
        for s in range(len(words) - size + 1) if words else ():
            windows[tuple(words[s:s + size])].add(item)
    sizes = sorted({len(w) for w in windows})
    for doc, text in docs:
        words, hit, found = alnum(text), set(), set()
        for size in sizes:
            for s in range(len(words) - size + 1):
                items_here = windows.get(tuple(words[s:s + size]))
                if items_here:
                    hit.update(range(s, s + size))
                    found |= items_here
        ids = sorted(str(i) for i in found)
        out.add((doc, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                 len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def url(text, rules):
    """(host, path, rule, its verdict)."""
    text = text or ""
    host = path = ""
    if "://" in text:
        rest = text.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = lower(host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.site), default=None)
    return host, path, best and best.site, best and best.verdict


def phrases(text, base):
    words, places, labels = alnum(text), [], set()
    for phrase, label in base.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
