import random

HIT = "event_id long, module int, channel int, energy int, energy_short int, timestamp_ns double, flags long"


def hit_rows(spark, rows):
    """Hits from ``(module, channel, energy, timestamp_ns)``."""
    return spark.createDataFrame([(i, m, c, e, e // 2, float(t), 0) for i, (m, c, e, t) in enumerate(rows)], HIT)


def random_hits(n, seed=0, span=20_000, modules=3, channels=4):
    rng = random.Random(seed)
    return [(rng.randrange(modules), rng.randrange(channels), rng.randrange(1, 5000), rng.randrange(span)) for _ in range(n)]
