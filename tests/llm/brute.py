"""Plain Python versions to hold results against."""

from collections import Counter, defaultdict


def documents(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if len(words) >= n:
        return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def components(rows, n, percent):
    """doc_id -> (size of its set, smallest id that it reaches)."""
    sets = {i: shingles(t, n) for i, t in rows}
    parent, inverted = {i: i for i in sets}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for j, common in Counter(j for s in sets[i] for j in inverted[s]).items():
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            inverted[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def row_components(rows, n, percent):
    """Of each row (id, size of its set, smallest id that it reaches): an id's links are those of all its texts, and
    rows with equal sets reach one another. Rows without text reach their own id alone."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(i, j):
        parent[root(j)] = root(i)

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and ((a == b and a is not None) or 100 * common >= percent * len(sets[i] | sets[j])):
                if (a is not None and b is not None) or sets[i] == sets[j]:
                    join(i, j)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[root(i)] = min(a, least.get(root(i), a))
    return [(a, len(sets[i]), least.get(root(i)) if sets[i] else a) for i, (a, _) in enumerate(rows)]
