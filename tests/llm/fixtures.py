import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, fp string, row long, digest string"


def texts(n=120, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Über", "naïve", "x1", "end.", "a|b", "#", "日本", "don't", "zeta", "eta,", "theta"]
    out = [None, "", " ", "\t\n", "one", "One  two", "one two", "onetwo", "A b\tc\n", "x" * 5000, " ".join(["same"] * 400), "word " * 9000]
    while len(out) < n:
        if len(out) > 20 and rng.random() < 0.35:
            base = out[rng.randrange(12, len(out))]
            kind = rng.random()
            ws = base.split(" ")
            if kind < 0.4:
                out.append(base)
            elif kind < 0.6:
                out.append(base.replace(" ", "  ", 1) + " ")
            else:
                ws[rng.randrange(len(ws))] = rng.choice(words)
                out.append(" ".join(ws))
        else:
            lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
            out.append("\n".join(lines))
    return out


def make(spark, rows):
    """Documents with columns whose names operators use themselves."""
    full = [(d, t, lang, s, len(t or ""), "clash", 9, "f", 1, "g") for d, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)
