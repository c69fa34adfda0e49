import random
from collections import defaultdict

from plantops.llm import quotes


def test_parse():
    assert quotes.parse("hi\nX wrote:\n> a\n>> b\n> > c\n> d\nbye") == [(0, "hi"), (1, "a"), (2, "b\nc"), (1, "d"), (0, "bye")]
    assert quotes.parse("") == [(0, "")]
    assert quotes.normal_hash("A  b\n c") == quotes.normal_hash("a B C") and quotes.normal_hash(" \n") is None


def test_links_threads_and_order(spark):
    rows = [(1, 0, "user", "First question\n\nsecond block"), (1, 1, "assistant", "answer one"), (1, 2, "user", "other topic"),
            (1, 3, "user", "> answer   ONE\nthanks"), (1, 4, "assistant", "> thanks\n>> answer one\nwelcome"), (1, 5, "user", "> second block\nlate"),
            (1, 6, "user", "> other topic\nmore"), (1, 7, "user", "> nobody said this\nhm"), (1, 8, "user", "> later text\nx"), (1, 9, "user", "later text"),
            (2, 0, "user", "> answer one\ncross"), (2, 1, "user", None), (2, 1, "user", None), (None, 3, "user", "> answer one\nq"), (3, None, "user", "alone"), (4, 0, "user", "> " + "deep " * 30_000)]
    rows += [(5, i, "user", f"m{i}" if not i else f"> m{i - 1}\nm{i}") for i in range(40)]           # a long chain
    rows += [(100 + i, 0, "user", "> hello there\nhello there") for i in range(50)]                   # a common passage that quotes itself
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, thread string")
    out = quotes.link_quotes(frame).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): r for r in out}
    assert [(got[1, t].reply_to_turn, got[1, t].thread) for t in range(10)] == [(None, 0), (None, 1), (None, 2), (1, 1), (3, 1), (0, 0), (2, 2), (None, 7), (None, 8), (None, 9)]
    assert sorted(range(10), key=lambda t: got[1, t].position) == [0, 5, 1, 3, 4, 2, 6, 7, 8, 9]
    assert (got[1, 4].n_quotes, got[1, 4].n_linked, got[1, 4].max_level, got[1, 4].body) == (2, 2, 2, "welcome")
    assert (got[2, 0].reply_to_conv, got[2, 0].reply_to_turn, got[2, 0].thread) == (1, 1, 0)
    assert got[None, 3].reply_to_turn is None and got[4, 0].n_quotes == 1 and got[3, None].position == 0
    assert all(got[5, i].thread == 0 and got[5, i].reply_to_turn == (i - 1 if i else None) and got[5, i].position == i for i in range(40))
    places = defaultdict(list)
    for r in out:
        places[r.conv_id].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_empty_table(spark):
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_one_thread_of_a_hot_conversation_is_numbered_in_order(spark):
    rows = [(1, t, "user", "root" if not t else "> root\nm" + str(t)) for t in range(3000)] + [(2, 0, "user", "alone")]
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)).collect()
    assert all(r.thread == 0 and r.position == r.turn for r in out if r.conv_id == 1)
    assert len(out) == 3001 and {r.position for r in out if r.conv_id == 2} == {0}


def test_partial_quotes_of_more_than_one_line_are_linked(spark):
    rows = [(1, 0, "Hello all\n\nfirst line of it\nsecond line of it\nthird line of it\n\nlast paragraph here"),
            (1, 1, "hello all\n\nA plan that is long. It has a second sentence, which is\nlong too. And a third one"),
            (1, 2, "> second line of it\n> third line of it\ntwo of three lines"),
            (1, 3, "> first line of it\n> second line of it\n> third line of it\n>\n> last paragraph here\ntwo of three paragraphs"),
            (1, 4, "> It has a\n> second sentence, which is long\n> too. And a third\n> one\nwrapped anew"),
            (1, 5, "> hello all\n> but nobody said any of the rest of this\nno"),
            (1, 6, "> Hello all\n>\n> A plan that is long.\nthe greeting was said before"),
            (2, 0, "> first line of it\n> third line of it\nfrom elsewhere")]
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(frame).collect()}
    assert [(got[1, t].n_linked, got[1, t].reply_to_turn) for t in range(2, 7)] == [(1, 0), (1, 0), (1, 1), (0, None), (1, 1)]
    assert (got[2, 0].n_linked, got[2, 0].reply_to_conv, got[2, 0].reply_to_turn) == (1, 1, 0)
    assert [got[1, t].thread for t in range(7)] == [0, 1, 0, 0, 1, 5, 1]


def test_a_quote_is_linked_elsewhere_if_its_own_conversation_says_it_first_but_later(spark):
    rows = [(1, 0, "> common passage\nhere"), (1, 4, "common passage"), (2, 3, "common passage"), (3, 1, "common passage"), (4, 0, "> common passage\nthere")]
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_linked, r.reply_to_conv, r.reply_to_turn) for r in quotes.link_quotes(frame).collect()}
    assert got[1, 0] == (1, 2, 3) and got[4, 0] == (1, 1, 4)


def test_announcements_leave_the_body():
    def body(t):
        return [p for n, p in quotes.parse(t) if not n]

    assert body("hi\nOn Mon, Ann\nwrote:\n> a\nbye") == ["hi", "bye"]
    assert body("hi\n\nOn 3 Feb 2020 at 10:00, Ann Lee\n<ann@example.org>\nwrote:\n\n> a") == ["hi\n"]
    assert body("On Tuesday Ann wrote:\n> a\nyes") == ["yes"] and quotes.parse("Ann wrote:\n> a") == [(1, "a")]
    assert body("On the other hand, this\nis what he wrote:\n> a") == ["On the other hand, this"]
    assert body("On Mon it rained\n\nAnn wrote:\n> a") == ["On Mon it rained\n"]
    assert body("she wrote:\nno quote") == ["she wrote:\nno quote"]
    assert quotes.parse("> On Mon, Ann\n> wrote:\n>> a\n> b") == [(2, "a"), (1, "b")]


def brute(rows):
    """Links of all messages by looking at every earlier sayer of every part."""
    body = defaultdict(set)  # (conv, turn) -> hashes that the message says itself
    quoted = defaultdict(set)
    for c, t, _, x in rows:
        parsed = quotes.parse(x or "")
        if c is not None and t is not None:
            body[c, t] |= quotes.own_passages("\n".join(p for n, p in parsed if not n).strip("\n"))
            quoted[c, t] |= {(n, quotes.normal_hash(p), tuple(quotes.quoted_parts(p))) for n, p in parsed if n and quotes.normal_hash(p)}
    to, linked = {}, {}
    for (c, t), passages in quoted.items():
        # passages that differ in layout alone are one: their parts are taken together
        merged = defaultdict(set)
        for n, h, parts in passages:
            merged[n, h] |= set(parts)
        found = []
        for (n, _), parts in merged.items():
            options = []
            for way in {w for w, _, _ in parts}:
                mine = [(h, k) for w, h, k in parts if w == way]
                for near in (True, False):
                    hits = []
                    for h, k in mine:
                        said = [m for m, own in body.items() if h in own and ((m[0] == c and m[1] < t) if near else m[0] != c)]
                        # of the own conversation its first sayer counts, of others the very first
                        first_here = min((m for m, own in body.items() if h in own and m[0] == c), default=None)
                        if said and not (near and first_here[1] >= t):
                            hits.append((min(said), k))
                    if hits and 2 * sum(k for _, k in hits) >= sum(k for _, k in mine):
                        options.append((sum(k for _, k in hits), near, -way, max(m for m, _ in hits)))
            if options:
                found.append((n, max(options)))
        linked[c, t] = len(found)
        for keep in (lambda n, o: n == 1 and o[1], lambda n, o: n == 1, lambda n, o: o[1], lambda n, o: True):
            if some := [o[3] for n, o in found if keep(n, o)]:
                to[c, t] = max(some)
                break
    def root(m):
        while m in to and to[m][0] == m[0]:
            m = to[m]
        return m[1]
    return {m: (linked.get(m, 0), to.get(m), root(m)) for m in body}


def test_links_are_those_of_a_brute_force_search(spark):
    rng = random.Random(7)
    lines = [f"{a} {b} {c}." for a in ("red", "blue") for b in ("cats", "dogs", "birds") for c in ("run", "sleep")]
    rows, said = [], []
    for c in range(12):
        for t in range(rng.randint(1, 9)):
            text = []
            for _ in range(rng.randint(0, 2)):
                old = rng.choice(said).split("\n") if said and rng.random() < 0.7 else rng.sample(lines, 2)
                part = old[rng.randint(0, len(old) - 1):][:rng.randint(1, 4)]
                text += [">" * rng.randint(1, 2) + " " + (x.upper() if rng.random() < 0.3 else x) for x in part]
            own = [rng.choice([*lines, ""]) for _ in range(rng.randint(0, 4))]
            said.append("\n".join(own))
            rows.append((c, t, "user", "\n".join([*text, *own])))
    want = brute(rows)
    assert sum(n for n, _, _ in want.values()) > 20 and any(m and m[0] != k[0] for k, (_, m, _) in want.items())
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = quotes.link_quotes(frame).collect()
    got = {(r.conv_id, r.turn): (r.n_linked, None if r.reply_to_turn is None else (r.reply_to_conv, r.reply_to_turn), r.thread) for r in out}
    assert got == want
    for c in {r.conv_id for r in out}:
        mine = sorted((r for r in out if r.conv_id == c), key=lambda r: r.position)
        assert [(r.thread, r.turn) for r in mine] == sorted((r.thread, r.turn) for r in mine)
