"""Ordinary numbers are nobody's, and long runs of them cost little."""

import random
import time

import pytest

from strokemill.llm import pii

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet(f"{DATA}/documents.parquet"))


def ordinary(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    y, m, n = rng.randint(1950, 2030), rng.randint(1, 12), rng.randint(1, 28)
    return rng.choice(
        [f"{y}-{m:02}-{n:02}", f"{n:02}.{m:02}.{y}", f"{y}-{m:02}-{n:02} {rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}", f"{m}/{n}/{y}"]
        + [f"v{rng.randint(0, 9)}.{rng.randint(0, 40)}.{rng.randint(0, 99)}", f"{d(3)},{d(3)}.{d(2)}", f"{rng.randint(1, 99)}.{d(2)} EUR", f"{y}-{y + 4}", f"{d(2)}:{d(2)}", f"#{d(7)}"]
    )


def test_dates_times_versions_and_prices_are_not_marked(model):
    rng = random.Random(3)
    wrong = []
    for _ in range(1000):
        words = [rng.choice(["due", "on", "since", "see", "release", "paid", "the", "and"]) for _ in range(4)]
        text = f"{words[0]} {ordinary(rng)} {words[1]} {words[2]} {ordinary(rng)} {words[3]}"
        base, spans = pii.find(text, model)
        wrong += [(text, s) for s in spans if s not in base]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize("piece", ["2024-01-15 ", "2023-11-02 10:30:00 ", "12345 67890 ", "a@ ", "1.2.3.4.5 ", "4111 "])
def test_long_runs_cost_little(model, piece):
    text = piece * (220_000 // len(piece))
    began = time.perf_counter()
    pii.find(text, model)
    assert time.perf_counter() - began < 6


def recall(model, make, n=60):
    rng, hit = random.Random(9), 0
    for _ in range(n):
        d = "".join(rng.choice("0123456789") for _ in range(10))
        span = make(rng, "2" + d[1:])
        text = f"please {rng.choice(['write to', 'call', 'ask'])} {span} {rng.choice(['today', 'soon', 'or wait'])}"
        a = text.index(span)
        hit += any((x[0], x[1]) == (a, a + len(span)) for x in pii.find(text, model)[1])
    return hit / n


def test_rewritten_spans_are_found(model):
    name = lambda rng: rng.choice(["jane", "max.muster", "info", "a_b"])
    host = lambda rng: rng.choice(["example.com", "mail.test.org", "firma.de"])
    got = {
        "email": recall(model, lambda r, d: f"{name(r)} [at] {host(r)}"),
        "email tight": recall(model, lambda r, d: f"{name(r)}[at]{host(r)}"),
        "phone": recall(model, lambda r, d: f"({d[:3]}) {d[3:6]}-{d[6:]}"),
        "phone dashes": recall(model, lambda r, d: f"{d[:3]}-{d[3:6]}-{d[6:]}"),
        "phone dots": recall(model, lambda r, d: f"{d[:3]}.{d[3:6]}.{d[6:]}"),
    }
    assert min(got.values()) >= 0.9, got
