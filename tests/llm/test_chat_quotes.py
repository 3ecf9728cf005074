import random
import re

import pytest
from tidelog.llm.chat_quotes import link_quotes

SCHEMA = "conv_id long, turn long, role string, text string"
MESSAGES = [
    (1, 0, "user", "First line here today.\nSecond line over there.\n\nBye"),
    (1, 1, "assistant", "Hi.\n\nAlice wrote:\n> first  LINE here, today\n> second line over there\nMy answer is yes of course."),
    (1, 2, "user", ">> First line here today.\n> My answer is yes of course.\nThanks"),
    (1, 3, "assistant", "> > nothing anyone said before\n> also invented by me\nok"),
    (1, 4, "user", "> Second line over there.\nBack to the start"),
    (1, 5, "user", "no quote, 3 > 2"),
    (2, 0, "user", "First line here today."),
    (2, 1, "user", "> My answer is yes of course.\nnot of this conversation"),
    (2, 2, "user", "> First line here today.\n> First line here today.\r\nrepeated"),
    (3, None, "user", "> First line here today."),
    (None, 1, "user", "> First line here today."),
    (4, 0, "user", None),
    (4, 1, None, ""),
    (5, 0, "user", "said twice by us"),
    (5, 1, "user", "said twice by us"),
    (5, 2, "user", "> said twice by us\nfrom the first"),
    (5, 2, "user", "> said twice by us\nfrom the first"),
    (5, 3, "user", "> from the first\n"),
]
# conv_id, turn -> text, n_quotes, n_linked, parent, thread, depth
WANT = {
    (1, 0): ("First line here today.\nSecond line over there.\n\nBye", 0, 0, None, 0, 0),
    (1, 1): ("Hi.\n\nMy answer is yes of course.", 3, 2, 0, 0, 1),
    (1, 2): ("Thanks", 2, 2, 1, 0, 2),
    (1, 3): ("ok", 2, 0, None, 3, 0),
    (1, 4): ("Back to the start", 1, 1, 0, 0, 1),
    (1, 5): ("no quote, 3 > 2", 0, 0, None, 5, 0),
    (2, 0): ("First line here today.", 0, 0, None, 0, 0),
    (2, 1): ("not of this conversation", 1, 0, None, 1, 0),
    (2, 2): ("repeated", 2, 1, 0, 0, 1),
    (3, None): ("", 0, 0, None, None, 0),
    (None, 1): ("", 0, 0, None, 1, 0),
    (4, 0): (None, 0, 0, None, 0, 0),
    (4, 1): ("", 0, 0, None, 1, 0),
    (5, 0): ("said twice by us", 0, 0, None, 0, 0),
    (5, 1): ("said twice by us", 0, 0, None, 1, 0),
    (5, 2): ("from the first", 1, 1, 0, 0, 1),
    (5, 3): ("", 1, 1, 2, 0, 2),
}


def test_links(spark):
    frame = spark.createDataFrame(MESSAGES, SCHEMA).selectExpr("*", "1 as parent_turn", "2 as level", "3 as body").repartition(3)
    got = link_quotes(frame).collect()
    assert len(got) == len(MESSAGES)
    for r in got:
        assert (r.text, r.n_quotes, r.n_linked, r.parent_turn, r.thread_turn, r.depth) == WANT[r.conv_id, r.turn], r


def test_long_chain_and_hot_conversation(spark):
    rows = [(1, i, "user", (f"> message number {i - 1} says it\n" if i else "") + f"message number {i} says it") for i in range(70)]
    rows += [(2, i, "user", "the very same line again\n" * 3) for i in range(300)] + [(2, 300 + i, "user", "> the very same line again\nyes") for i in range(300)]
    got = link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.depth == r.turn and r.thread_turn == 0 for r in got if r.conv_id == 1)
    assert {(r.parent_turn, r.depth) for r in got if r.conv_id == 2 and r.turn >= 300} == {(0, 1)}


def test_empty(spark):
    assert link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_parts_of_messages(spark):
    filler = "Quite another text of ours, to be the first."
    rows = [
        # a paragraph with other line breaks, a sentence, a part of a sentence over two lines
        (1, 0, "user", filler),
        (1, 1, "user", "Alpha one is here\nalpha two is there\n\nBeta one came late\nbeta two came later"),
        (1, 2, "user", "> Beta one came late beta two came later\nok"),
        (1, 3, "user", "The first sentence is long. The second one is short! And a third one ends it."),
        (1, 4, "user", "> The second one is short!\nno"),
        (1, 5, "user", "> one is here alpha\n> two\nwell"),
        # a sentence that is changed beside one that is not
        (1, 6, "user", "> Changed beyond knowing. And a third one ends it.\nwell"),
        (1, 7, "user", "> one is her\nnot whole words"),
        (1, 8, "user", "> a third one starts it\nthe beginning only"),
        # short lines
        (2, 0, "user", filler + "\nNo"),
        (2, 1, "user", "Well\nYes\nI will think about it\nAgreed fully\nBye"),
        (2, 2, "user", "> Yes\n> Agreed fully\nfine"),
        (2, 3, "user", "I will think about it"),
        (2, 4, "user", "> Yes\n> invented by me now\nfine"),
        (2, 5, "user", "> No\n> I will think about it\nlong lines go first"),
        # said later only; said in another conversation only
        (3, 0, "user", "> a text that is to come\nhow so"),
        (3, 1, "user", "Here is a text that is to come, at last."),
        (4, 0, "user", filler),
        (4, 1, "user", "> beta two came\nwho?"),
        # lines said before apart, the passage in one message
        (5, 0, "user", "The line of the one kind"),
        (5, 1, "user", "The line of the other kind"),
        (5, 2, "user", "The line of the one kind\nThe line of the other kind\nand more"),
        (5, 3, "user", "> The line of the one kind\n> The line of the other kind\nyes"),
    ]
    got = {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    parents = {k: r.parent_turn for k, r in got.items() if r.n_quotes}
    assert parents == {(1, 2): 1, (1, 4): 3, (1, 5): 1, (1, 6): 3, (1, 7): None, (1, 8): None, (2, 2): 1, (2, 4): 1, (2, 5): 1, (3, 0): None, (4, 1): None, (5, 3): 2}
    assert all((r.n_linked > 0) == (r.parent_turn is not None) for r in got.values())
    assert (got[1, 2].n_quotes, got[1, 2].n_linked) == (1, 1) and (got[1, 6].n_quotes, got[1, 6].n_linked) == (3, 1)


def test_parts_in_a_hot_conversation(spark):
    rows = [(1, i, "user", f"Before it number {i} says so. The very same text, said again and again by all. After it") for i in range(300)]
    rows += [(1, 300 + i, "user", f"> The very same text, said again and again by all. After it\nyes\n> number {i} says\nand no\n> The very same text, said again and again by all {i}") for i in range(300)]
    got = [r for r in link_quotes(spark.createDataFrame(rows, SCHEMA)).collect() if r.turn >= 300]
    # two parts of one sentence from the first message, and one from message i
    assert {(r.n_quotes, r.n_linked) for r in got} == {(5, 4)} and {r.parent_turn for r in got} == {0}


def normal(text):
    return re.sub(r"[ \t\n\x0b\f\r!-/:-@\[-`{-~]+", " ", text.lower()).strip(" ")


def plain(messages):
    """By loops over one conversation's messages (turn, text): (turn, text without quotes, n_quotes, n_linked, parent, thread, depth)."""
    parsed = {}
    for turn, text in messages:
        lines = []
        quoting = re.search(r"(?m)^[ \t]*>", text)
        for line in re.sub("\r\n?", "\n", text).split("\n"):
            marks = re.match(r"[ \t]*((?:>[ \t]?)+)", line)
            lines.append([marks[1].count(">"), line[marks.end() :]] if marks else [0, line])
        for i, (level, line) in enumerate(lines[:-1]):
            if level == 0 and lines[i + 1][0] > 0 and re.search(r"(?i)(?:wrote|writes|said)[^:]{0,80}:[ \t]*$", line):
                lines[i][0] = -1
        runs = []
        for level, line in lines:
            if not runs or runs[-1][0] != level:
                runs.append((level, []))
            runs[-1][1].append(line)
        body = text
        if quoting:
            body = "\n".join(x for level, part in runs for x in part if level == 0)
            body = re.sub(r"\n\s*\n\s*\n", "\n\n", body).strip()
        parsed[turn] = runs, body, bool(quoting)
    said, inside = {}, {}
    for turn, (runs, body, quoting) in sorted(parsed.items()):
        for part in [p for level, p in runs if level == 0] + ([body.split("\n")] if quoting else []):
            for passage in [" ".join(part), *part]:
                said.setdefault(normal(passage), turn)
    out = {}
    for turn, (runs, body, _) in parsed.items():
        pieces = {}
        for r, (level, part) in enumerate(runs):
            if level > 0:
                whole = "\n".join(part)
                wide = [(x, False) for x in [whole, *re.split(r"\n[ \t]*\n", whole)]]
                narrow = [(x, True) for x in [*part, *(y for x in part for y in re.split(r"(?<=[.!?])\s+", x))]]
                for x, narrowly in wide + narrow:
                    if n := normal(x):
                        several, short = sum(bool(y.strip(" ")) for y in x.split("\n")) > 1, narrowly and len(n.split()) < 3
                        old = pieces.get((level, n), (r, several, short))
                        pieces[level, n] = min(old[0], r), min(old[1], several), min(old[2], short)
        counts, weights = {}, {}
        for (level, n), (r, several, short) in pieces.items():
            own = said.get(n)
            original, within = (own if own is not None and own < turn else None), False
            if original is None:
                if n not in inside:
                    inside[n] = min((t for t, (_, b, _) in parsed.items() if f" {n} " in f" {normal(b)} "), default=None)
                if inside[n] is not None and inside[n] < turn:
                    original, within, short = inside[n], True, short or len(n.split()) < 3
            c = counts.setdefault(r, [0, 0, 0, 0])
            c[0] += 1
            c[1] += original is not None and not within
            c[2] += within and not several
            c[3] += within and several
            if level == 1 and original is not None:
                weights.setdefault(original, [0, 0])[short] += len(n)
        parent = max(weights, key=lambda o: (*weights[o], o), default=None)
        out[turn] = body, sum(c[0] for c in counts.values()), sum(c[1] + c[2] + (c[3] if not c[1] else 0) for c in counts.values()), parent
    rows = []
    for turn, (body, n, linked, parent) in out.items():
        thread, depth = turn, 0
        while out[thread][3] is not None:
            thread, depth = out[thread][3], depth + 1
        rows.append((turn, body, n, linked, parent, thread, depth))
    return sorted(rows)


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(40)] + ["ok", "yes", "it's"]
    sentence = lambda: " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 4, 9]))).capitalize() + rnd.choice([".", "!", "?"])
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(rnd.randint(1, 14)):
            parts = []
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                if texts:
                    source = rnd.choice(texts).split("\n")
                    lo = rnd.randrange(len(source))
                    chosen = source[lo : lo + rnd.randint(1, 5)]
                    how = rnd.random()
                    if how < 0.3:
                        words = " ".join(chosen).split(" ")
                        k = rnd.randrange(len(words))
                        chosen = [" ".join(words[k : k + 6])] if not words[k].startswith(">") else ["nowhere said by anyone"]
                    if rnd.random() < 0.3:
                        parts.append(rnd.choice(["On Monday A wrote:", "b@c said:"]))
                    parts.extend((">" if x.startswith(">") else "> ") + x for x in chosen)
                parts.append("\n\n".join(" ".join(sentence() for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(0, 2))))
            texts.append("\n".join(parts) if parts else " ".join(sentence() for _ in range(rnd.randint(1, 4))))
        rows += [(conv, turn, "user", text) for turn, text in enumerate(texts)]
    got = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sum(r.n_linked for r in got) > 20
    for conv in range(12):
        want = plain([(t, text) for c, t, _, text in rows if c == conv])
        assert sorted((r.turn, r.text, r.n_quotes, r.n_linked, r.parent_turn, r.thread_turn, r.depth) for r in got if r.conv_id == conv) == want


def test_long_text_and_empty_body(spark):
    """A very long message, and one that is quotes of many levels and nothing else."""
    rows = [(1, 0, "u", "word " * 200_000 + "the end of it all"), (1, 1, "u", "\n".join(">" * k + f" level {k} of it" for k in range(1, 40))), (1, 2, "u", "> the end of it all"), (1, 3, "u", ""), (1, 4, "u", None)]
    got = {r.turn: r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 5 and got[1].text == "" and got[1].n_quotes == 39 and got[2].parent_turn == 0 and got[4].text is None
