import random

import pytest

from watchloom.llm import licenses as L

from .fixtures import documents, prose, texts


@pytest.fixture(scope="module")
def scanner():
    return L.Scanner(L.TEMPLATES)


def containment(template, text):
    of = lambda t: {tuple(w[i : i + 5]) for w in [L.words_of(t)] for i in range(len(w) - 4)}
    wanted = of(template)
    return len(wanted & of(text)) / len(wanted)


def test_every_template_is_found_anywhere(scanner):
    for name, body in L.TEMPLATES.items():
        for before in (0, 1, 7, 50, 333):
            found = {m[0]: m for m in scanner.scan(f"{prose(before, before)}\n{body.upper()}\n{prose(before + 1, before * 2)}")}
            assert name in found and found[name][1] == 1.0 and found[name][2] == before


def test_altered_copies_equal_brute_force(scanner):
    r, wanted, missed, wrong = random.Random(2), 0, 0, 0
    for k in range(300):
        name = r.choice(sorted(L.TEMPLATES))
        words = L.TEMPLATES[name].split()
        for _ in range(r.randrange(4)):
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice([[], ["other"], [words[at], "more"]])
        text = f"{prose(k, r.randrange(80))} {' '.join(words)} {prose(k + 1, r.randrange(80))}"
        found = {m[0] for m in scanner.scan(text)}
        for n, body in L.TEMPLATES.items():
            true = containment(body, text) >= L.THRESHOLD
            wanted += true
            missed += true and n not in found
            wrong += n in found and not true
    assert wanted > 200 and missed <= 0.02 * wanted and wrong == 0


def test_neighbours_and_slices_do_not_matter(scanner, monkeypatch):
    r = random.Random(9)
    pool = [*L.TEMPLATES.values(), None, "", "few words", prose(1, 300), prose(2, 40)]
    batch = [(f"{prose(k, r.randrange(40))} {r.choice(pool) or ''} {prose(k + 1, r.randrange(40))}" if r.random() < 0.5 else r.choice(pool)) for k in range(120)]
    want = [scanner.scan(t) for t in batch]
    assert scanner.scan_all(batch) == want and sum(map(len, want)) > 50
    monkeypatch.setattr(L, "SLICE", 37)
    assert scanner.scan_all(batch) == want


def test_band_settings_reach_the_certainty():
    for likeness in (0.1, 0.3, 0.5, 0.8, 0.95, 1.0):
        bands, rows = L.band_settings(likeness)
        assert 1 - (1 - likeness**rows) ** bands >= L.CERTAINTY - 1e-9


def test_clean_texts_match_nothing(scanner):
    for t in [*texts(), "Released under the", "the license of the software is not named here at all"]:
        assert scanner.scan(t) == []


def test_rows(spark):
    given = [(i, t, "en", "s", 1, "x", None, i, "r", "h", 1) for i, t in enumerate([None, "", "Released under the MIT License.", "x " * 30_000 + L.TEMPLATES["MIT"]])]
    out = L.scan(documents(spark, given + given[2:]))
    assert sorted((r["doc_id"], r["template"]) for r in out.collect()) == [(2, "MIT-notice")] * 2 + [(3, "MIT")] * 2
    assert L.scan(documents(spark, given), {}).count() == 0 and L.scan(documents(spark, [])).count() == 0
    with pytest.raises(ValueError, match="under 5"):
        L.scan(documents(spark, given), {"short": "MIT License"})
