import random


def near_texts(seed, count=120):
    """Groups of near copies, shared passages, short and missing texts."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(r.choice((30, 300, 3000)))]
    bases = [[r.choice(words) for _ in range(r.choice((1, 3, 8, 40, 90, 150, 400)))] for _ in range(6)]
    passage = [r.choice(words) for _ in range(60)]
    out = []
    for i in range(count):
        b = list(r.choice(bases))
        for _ in range(r.choice((0, 1, 1, 2, 3, len(b) // 30))):
            k, op = r.randrange(len(b) + 1), r.random()
            if op < 0.4 and b:
                b[k % len(b)] = r.choice(words)
            elif op < 0.7:
                b.insert(k, r.choice(words))
            elif b:
                del b[k % len(b)]
        if r.random() < 0.15:
            b = passage + b
        sep = "\n" if r.random() < 0.3 else " "
        out.append((i, sep.join(b) if r.random() > 0.03 else None))
    return out
