import re
import time

from icekeel.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", "plain words only", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "mit LICENSE mit license general public license é-license apache  license", "General\nPublic\tLicense", "SPDX-License-Identifier: MIT",
    "mit licenses emit license mit_license mitelicense", "ſ K mit license", "x " * 3000 + "MIT license " * 50,
]


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate([*TEXTS, *TEXTS[3:5]])], "doc_id long, text string, score int, words string")
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    assert len(got) == len(TEXTS) + 2
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert (got[2].labels, got[2].score) == ("", 0.0)
    assert got[6].labels == "cc-by-nc" and got[6].score == 0.7
    assert got[9].labels == "mit" and got[9].score == 1.0
    assert [tuple(d) for d in got[4].detections] == [("apache", 70, 1, 46)]


def test_rules_are_ordered_signatures():
    rules = L.rules()
    assert len(rules) >= 200
    assert all(re.compile(r) for _, _, r, _ in rules)


def test_no_python_in_the_plan(spark):
    df = L.scan(spark.createDataFrame([(1, "MIT License")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def written(regex):
    """Texts that a rule's regex matches: each alternative, option and repetition at its ends, each choice once."""
    from re import _parser as parser

    def strings(tree):
        out = [""]
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                parts = [chr(arg)]
            elif name == "IN":
                parts = [chr(c) for kind, c in arg if str(kind) == "LITERAL"] or ["x"]
            elif name == "ANY":
                parts = ["x"]
            elif name == "BRANCH":
                parts = [s for branch in arg[1] for s in strings(branch)]
            elif name == "SUBPATTERN":
                parts = strings(arg[3])
            else:
                assert name in ("MAX_REPEAT", "MIN_REPEAT"), name
                low, _, inner = arg
                parts = ([""] if not low else []) + [s * max(low, 1) for s in strings(inner)]
            out = [a + p for a in out for p in parts]
        return out

    return strings(parser.parse(regex))


def test_every_match_of_a_rule_holds_a_keyword():
    for _, keywords, regex, _ in L.rules():
        for text in written(regex):
            assert re.fullmatch(regex, text) and any(f" {k}" in f" {text}" for k in keywords.split("|")), (keywords, text)


def test_every_alternative_is_found_like_without_keywords(spark):
    """Each rule's texts, in capitals and with line breaks between words, against all rules tried one by one."""
    texts = sorted({t for _, _, regex, _ in L.rules() for t in written(regex)[:: max(1, len(written(regex)) // 6)]})
    texts += ["dual GPL v2 / 3-clause BSD", "CC BY-SA 4.0", "same terms as Perl", "MPL 2.0", "proprietary and confidential", "public\ndomain", "in the public\n domain", "Psf License"]
    rules = [(label, re.compile(f"(?<= ){regex}(?= )"), priority) for label, _, regex, priority in L.rules()]
    docs = spark.createDataFrame([(i, f"({t.upper()})".replace(" ", " \n")) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in L.scan(docs).collect():
        line = f" {' '.join(texts[r.doc_id].lower().replace('/', ' ').replace('-', ' ').replace('.', ' ').split())} "
        found = [(label, p, m.start(), m.end()) for label, rule, p in rules for m in rule.finditer(line)]
        kept = {d for d in found if not any(e[2] <= d[2] and e[3] >= d[3] and (e[1] > d[1] or e[1] == d[1] and e[3] - e[2] > d[3] - d[2]) for e in found)}
        assert sorted(tuple(d) for d in r.detections) == sorted(d for d in found if d in kept), line
        assert {d[0] for d in kept} <= set(r.labels.split(",")) | {""}


def test_any_of_finds_what_its_words_find():
    words = sorted({f" {k}" for _, b, _, _ in L.rules() for k in b.split("|")})
    regex = re.compile(L.any_of(words))
    for w in words:
        assert regex.search(f"x{w}y") and bool(regex.search(f"x{w[:-1]}")) == any(v in f"x{w[:-1]}" for v in words)
    assert not regex.search(" a plain line about nothing")


def test_many_detections_in_a_text(spark):
    """Fifty thousand detections take seconds, and are what the plain rule of suppression leaves."""
    docs = spark.createDataFrame([(1, "mit license " * 50_000), (2, "released under the mit license " * 700 + "gnu general public license version 3 apache " * 700)], "doc_id long, text string")
    L.scan(docs.limit(0)).collect()
    began = time.perf_counter()
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    assert time.perf_counter() - began < 60
    assert len(got[1].detections) == got[1].n_base == 50_000 and got[1].labels == "mit"
    assert [(d.first, d.last) for d in got[1].detections] == [(1 + 12 * k, 12 + 12 * k) for k in range(50_000)]
    assert len(got[2].detections) == 1400 and got[2].labels == "gpl,gpl-3.0,mit"
