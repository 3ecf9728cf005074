import random
import re
import re._constants as sre
import re._parser as sre_parser
import time

from tidelog.llm.license_scan import BASE_PHRASES, LicenseScanner, parse_rules, resolve, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(q := p.split())] == q]
    return len(words), sorted(places)


TEXTS = {
    "": set(),
    "Ein Text mit Licht, der frei ist.": set(),
    "Released under the MIT License.": {"mit"},
    "Licensed under the Apache License, Version 2.0.": {"apache-2.0", "license-notice"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl", "gpl-3.0", "license-notice"},
    "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc-4.0", "license-notice"},
    "All rights reserved.": {"reserved", "all-rights-reserved"},
    "accby ALL  rights-RESERVED cc\nby CC BY general public license général": {"reserved", "all-rights-reserved", "cc-by", "gpl"},
    "SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2.0-or-later"},
    "GNU Lesser General Public License v2.1": {"gpl", "lgpl-2.1"},
    "https://creativecommons.org/licenses/by-sa/4.0/legalcode": {"cc-by-sa-4.0"},
    "small bits of halls, rights reserved": {"all-rights-reserved"} - {"all-rights-reserved"},
}


def test_rules():
    rules = parse_rules()
    assert len(rules) >= 250 and all(1 <= r.priority <= 9 and r.keyword for r in rules)


def test_texts():
    scanner = LicenseScanner()
    for text, labels in TEXTS.items():
        n, places, stand = scanner.scan(text.encode())
        assert (n, places) == base(text), text
        assert {*(x for _, x in places), *(d.label for d in stand)} == labels, text


def test_gate_changes_nothing():
    """The keyword gate against trying every rule on every text."""
    scanner, rules = LicenseScanner(), parse_rules()
    for text in TEXTS:
        normal = f" {' '.join(WORD.findall(text.lower()))} "
        every = {(m.start(), m.end(), i) for i, r in enumerate(rules) for m in r.regex.finditer(normal)}
        want = sorted(rules[i].label for _, _, i in resolve(sorted(every), rules))
        assert sorted(d.label for d in scanner.scan(text.encode())[2]) == want, text


def strings(parsed):
    """Strings that a rule's regex matches: every alternative and letter; repeats the fewest times, once more, and the most times."""
    out = [""]
    for op, arg in parsed:
        if op is sre.LITERAL:
            new = [chr(arg)]
        elif op is sre.IN:
            new = [chr(c) if kind is sre.LITERAL else "x" if c is sre.CATEGORY_NOT_SPACE else "0" for kind, c in arg]
        elif op is sre.SUBPATTERN:
            new = strings(arg[3])
        elif op is sre.BRANCH:
            new = [x for part in arg[1] for x in strings(part)]
        else:
            assert op in (sre.MAX_REPEAT, sre.MIN_REPEAT), op
            few, most, inner = arg
            new = [x * n for n in {few, min(few + 1, most), min(most, few + 12)} for x in strings(inner)]
        out = [a + b for a in out for b in dict.fromkeys(new)]
    return list(dict.fromkeys(out))


def test_every_string_of_a_rule_has_its_keyword():
    for rule in parse_rules():
        every = [x for x in strings(sre_parser.parse(rule.regex.pattern[len("(?<= )") : -len("(?= )")]))]
        assert every and all(rule.regex.search(f" {x} ") for x in every), rule
        assert [x for x in every if rule.keyword not in f" {x} "] == [], rule


def test_alternatives_get_their_labels():
    for text, label in {"Reprinted with kind permission.": "permission", "an Open RAIL license": "openrail", "See the LICENSE.txt": "see-license", "PostgreSQL Licence": "postgresql"}.items():
        assert label in {d.label for d in LicenseScanner().scan(text.encode())[2]}, text


def test_suppression():
    rules = parse_rules("low|4|k|a b c d\nhigh|8|k|b c\nsame|8|k|c d e\ninner|8|k|b")
    assert [rules[i].label for _, _, i in resolve([(0, 7, 0), (2, 5, 1), (4, 9, 2), (2, 3, 3)], rules)] == ["high", "same"]


def test_frame(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (None, "cc by"), (91, "x " * 100_000 + "cc by"), (92, "cc by"), (92, "cc by")]
    got = scan_licenses(docs_of(rows).selectExpr("*", "'z' as labels", "1 as score")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        n, places = base(t)
        r = by[i]
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
    assert by[91].first_word == 100_000 and by[90].labels == ""
    assert scan_licenses(docs_of([])).count() == 0


def plain_resolve(found, rules):
    """One by one by priority, length, rule and start, against all that are kept."""
    kept = []
    for start, end, rule in sorted(set(found), key=lambda x: (-rules[x[2]].priority, x[0] - x[1], x[2], x[0])):
        over = [k for k in kept if start < k[1] and k[0] < end]
        if not any(k[0] <= start and end <= k[1] or rules[k[2]].priority > rules[rule].priority for k in over):
            kept.append((start, end, rule))
    return sorted(kept)


def test_resolution_against_the_plain_one():
    rules = parse_rules("\n".join(f"r{i}|{p}|k|k" for i, p in enumerate([9, 9, 8, 5, 5, 5, 1])))
    rnd = random.Random(3)
    for _ in range(400):
        found = [(a := rnd.randint(0, 60), a + rnd.randint(1, 15), rnd.randrange(7)) for _ in range(rnd.randint(0, 40))]
        assert resolve(found, rules) == plain_resolve(found, rules)


def test_very_many_detections():
    began = time.process_time()
    scanner, line = LicenseScanner(), "copyright (c) 2020 some one all rights reserved mit license "
    n, places, stand = scanner.scan(line.encode() * 60_000)
    few = scanner.scan(line.encode() * 6)
    assert time.process_time() - began < 60
    assert len(places) == 60_000 and n == 10_000 * few[0] and len(stand) == 10_000 * len(few[2]) >= 120_000
