"""Random stretches inside longer runs, without digits, beside base spans."""

import random

from pagewright.llm import secrets


def test_secrets_inside_longer_runs_and_without_digits():
    r = random.Random(6)
    ratios = secrets.train(secrets.labelled_samples())
    letters, any_of = secrets.SYMBOLS[:52], secrets.SYMBOLS[:62]
    held = {"letters": 0, "hook": 0, "beside": 0, "short": 0}
    for _ in range(100):
        key = "".join(r.choices(any_of, k=28))
        held["letters"] += bool(secrets.markov_spans("".join(r.choices(letters, k=28)).encode(), True, ratios, []))
        url = f"é services/channel/{key}/export/settings/default/option"
        spans = secrets.markov_spans(url.encode(), False, ratios, [])
        at = url.index(key)
        held["hook"] += any(max(s, at) < min(e, at + 28) and min(e, at + 28) - max(s, at) > 14 for s, e, _ in spans)
        pair = f"é token=abcdefgh={key}"
        spans = secrets.markov_spans(pair.encode(), False, ratios, [(2, 16, 0)])
        held["beside"] += bool(spans) and all(s >= 16 for s, _, _ in spans)
        held["short"] += bool(secrets.markov_spans("".join(r.choices(any_of, k=18)).encode(), True, ratios, []))
    assert min(held.values()) > 80, held
    for plain in ("x" * 500, "services/channel/export/settings/default_option", "", "é", "0" * 40):
        assert not secrets.markov_spans(plain.encode(), plain.isascii(), ratios, [])


def test_keys_are_found_and_words_of_several_languages_are_not():
    r = random.Random(11)
    ratios = secrets.train(secrets.labelled_samples())
    for n in (16, 24, 32):
        keys = ["".join(r.choices(secrets.SYMBOLS[:62], k=n)) for _ in range(200)]
        assert sum(bool(secrets.markov_spans(k.encode(), True, ratios, [])) for k in keys) >= 180, n
    own = secrets.labelled_samples(1500, seed=99)
    wrong = [t for t, label in own if not label and secrets.markov_spans(t.encode(), t.isascii(), ratios, [])]
    assert len(wrong) <= 2, wrong
    for plain in ("aiaiai", "élèvexeux", "donaudampfschifffahrtsgesellschaft", "Geschwindigkeitsbegrenzung", "información_de_año_2021", "être&&&", "jaque%%%", "2021-03-04T10:20:30", "https://example.org/a/list/of/pages?id=12"):
        assert not secrets.markov_spans(plain.encode(), plain.isascii(), ratios, []), plain


def test_the_first_stretch_has_the_best_sum():
    """Of one stretch's neighbourhood no other range has a greater sum, by trying all."""
    r = random.Random(12)
    for _ in range(300):
        gains = [r.choice((-3.0, -1.0, 2.0, 4.0)) for _ in range(r.randint(1, 40))]
        found = list(secrets.stretches(gains))
        best = max((sum(gains[i:j]) for i in range(len(gains)) for j in range(i + 1, len(gains) + 1)), default=0)
        assert bool(found) == (best >= secrets.MIN_GAIN)
        if found:
            assert max(sum(gains[a:b]) for a, b in found) == best
