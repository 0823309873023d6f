"""Plain Python versions of the operators, written from their descriptions."""

from __future__ import annotations


def anchored(seconds, reach):
    out, anchor = [], None
    for s in seconds:
        if anchor is None or s - anchor > reach:
            anchor = s
        out.append(anchor)
    return out


def gap_chunk(times, interval):
    """``times`` ascending."""
    keys, start, previous = [], None, None
    for t in times:
        if previous is None or t - previous > interval:
            start = t
        keys.append((start, (t - start) // interval))
        previous = t
    number = {key: i for i, key in enumerate(sorted(set(keys)), 1)}
    return [number[key] for key in keys]


def sliding(ids, labels, size, stride, pad=1, tail=True, compat=False):
    """(index, ids, next, anomaly, classes) of one session, from the closed form: full windows start at 0, s, 2s, ..
    below n - size, and the tail window at the next multiple of the stride."""
    n = len(ids)
    cls = [t if l > 0 else 0 for t, l in zip(ids, labels)]
    whole = -(-max(n - size, 0) // stride)
    fill = lambda values, filler: values + [filler] * (size - len(values))
    out = [
        (k, ids[k * stride:k * stride + size], ids[k * stride + size], max(labels[k * stride:k * stride + size + 1]),
         cls[k * stride:k * stride + size])
        for k in range(whole)
    ]
    if tail:
        start = whole * stride
        rest = slice(start, max(n - 1, start))
        classes = fill(cls[:max(n - start, 0)], 1) if compat else fill(cls[rest], 0)
        out.append((whole, fill(ids[rest], pad), ids[-1], max(labels[start:], default=0), classes))
    return out


def frames(values, size, stride, compat=False):
    n = len(values)
    if n < size:
        return [values + [0] * (size - n)]
    out = []
    for i in range(0, n, stride):
        if compat and stride > 1 and i + 1 >= size:
            break
        part = values[i:i + size]
        if len(part) == size or (stride > 1 and size % stride != 0):
            out.append(part + [0] * (size - len(part)))
    return out


def next_event_model(windows, order, k):
    """``windows``: (ids before filling, next id)."""
    counts = {}
    for ids, nxt in windows:
        for m in range(min(order, len(ids)) + 1):
            row = counts.setdefault(tuple(ids[len(ids) - m:]), {})
            row[nxt] = row.get(nxt, 0) + 1
    return {c: [e for e, _ in sorted(r.items(), key=lambda x: (-x[1], x[0]))[:k]] for c, r in counts.items()}


def predict(model, ids, order):
    for m in range(min(order, len(ids)), -1, -1):
        context = tuple(ids[len(ids) - m:])
        if context in model:
            return model[context]
    return []


def chosen(f1s, patience):
    best, at, misses = float("-inf"), None, 0
    for i, f1 in enumerate(f1s, 1):
        if f1 > best:
            best, at, misses = f1, i, 0
        else:
            misses += 1
            if misses >= patience:
                return at, best, i
    return at, best, len(f1s)
