import random

from sleuthgrid.llm.chat_format import BEGIN, FREE, N_OBS, ROLES, STATES, chain, labelled_transcripts, marker, model, observe, parse_transcripts, product, role_of, transcripts, viterbi


def test_markers():
    assert [marker(x)[0] for x in ("User: hi", "### Assistant:", "<|system|>", "<|im_start|>user", "**Human:** hi", "A: b", "Alice: hi", "a user said: no", "plain", "")] == [2, 3, 1, 2, 2, 3, 4, 0, 0, 0]


def likeliest(obs):
    """The best log-likelihood, by trying all ways of states."""
    steps, ways = model(), {(BEGIN,): 0}
    for o in obs:
        ways = {(*w, s): v + int(steps[o][w[-1], s]) for w, v in ways.items() for s in range(STATES) if steps[o][w[-1], s] > -(1 << 49)}
    return max(ways.values())


def worth(obs, states):
    return sum(int(model()[o][a, b]) for o, a, b in zip(obs, [BEGIN, *states], states, strict=False))


def test_viterbi_as_enumeration():
    rng = random.Random(7)
    for _ in range(12):
        obs = bytes(rng.randrange(N_OBS) for _ in range(4))
        if any(o >= FREE and o % 2 for o in obs[:1]):
            continue
        assert worth(obs, viterbi(obs)) == likeliest(obs)


def test_parts_joined_as_whole():
    rng = random.Random(1)
    for _ in range(40):
        obs = bytes(rng.randrange(FREE) for _ in range(rng.randint(2, 40)))
        cuts = sorted({0, len(obs), *(rng.randrange(1, len(obs)) for _ in range(rng.randint(1, 4)))})
        pieces = [obs[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        got = [s for p, (entry, end) in zip(pieces, chain([product(p) for p in pieces]), strict=True) for s in viterbi(p, entry, end)]
        assert worth(obs, got) == worth(obs, viterbi(obs))


def test_held_out_transcripts():
    right = total = 0
    for lines, states in labelled_transcripts(200, seed=99):
        got = viterbi(observe(lines))
        right, total = right + sum(a // 2 == b // 2 for a, b in zip(got, states, strict=True)), total + len(states)
    assert right / total > 0.95


def test_given_conversations(spark):
    """A given speaker wins: role and text of every row come back."""
    talks = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    want = sorted((r["conv_id"], r["turn"], {"human": "user"}.get(r["role"], r["role"]), r["text"]) for r in talks.collect())
    got = parse_transcripts(talks.repartition(3), speaker="role").collect()
    assert sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in got) == want and all(r["opens"] for r in got)


def test_roles_come_back_from_written_transcripts(spark):
    """As the query has it, without the speaker's column: markers in five dialects, one row in ten without one."""
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in talks.collect()}
    written = transcripts(talks)
    bare = {(r["conv_id"], r["turn"]) for r in written.collect() if r["text"] == want[r["conv_id"], r["turn"]][1]}
    found, runs = {}, {}
    for r in sorted(parse_transcripts(written.repartition(3)).collect(), key=lambda r: (r["conv_id"], r["turn"], r["line"])):
        at = r["conv_id"], r["turn"]
        found.setdefault(at, (r["role"], r["opens"]))
        runs[at] = [*runs.get(at, []), r["text"]]
    right = {at for at, (role, _) in want.items() if found[at] == (role, True)}
    assert 0.05 < len(bare) / len(want) < 0.2 and all(at in right for at in want if at not in bare)
    assert len(right & bare) >= 0.75 * len(bare) and len(right) >= 0.97 * len(want)
    assert sum("\n".join(runs[at]) == want[at][1] for at in want) >= 0.99 * len(want)  # markers go, every word stays


def plain_viterbi(lines):  # observations
    """The likeliest states by trying all ways, line by line, of those that end alike the best."""
    best = {BEGIN: (0, [])}
    for o in lines:
        step = model()[o]
        best = {t: max(((v + int(step[s, t]), [*way, t]) for s, (v, way) in best.items()), key=lambda x: x[0]) for t in range(STATES)}
    return max(best.values(), key=lambda x: x[0])


def test_query_as_a_plain_decoder(spark):
    talks = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    lines = {}
    for r in sorted(transcripts(talks).collect(), key=lambda r: (r["conv_id"], r["turn"])):
        own = r["text"].split("\n")
        lines.setdefault(r["conv_id"], []).extend(zip([r["turn"]] * len(own), observe(own), strict=True))
    got = {}
    for r in sorted(parse_transcripts(transcripts(talks)).collect(), key=lambda r: (r["conv_id"], r["turn"], r["line"])):
        got.setdefault(r["conv_id"], []).append((r["turn"], r["line"], r["role"]))
    for conv, own in lines.items():
        obs = bytes(x for _, x in own)
        worth_, _ = plain_viterbi(obs)
        assert worth(obs, viterbi(obs)) == worth_
        states, first = viterbi(obs), {}
        for (turn, _), state in zip(own, states, strict=True):
            first.setdefault(turn, ROLES[state // 2])
        assert {t: role for t, line, role in got[conv] if line == 0} == first


def test_one_long_conversation_over_many_partitions(spark):
    rows = [(1, t, ("user", "assistant")[t % 2] if t % 5 else None, f"text number {t} of it" + ("?" if t % 2 == 0 else ".")) for t in range(400)]
    rows += [(2, t, None, f"{('User', 'AI')[t % 2]}: other {t}") for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as seq", "3 as obs", "4 as speaker")
    out = sorted(parse_transcripts(df, speaker="role").collect(), key=lambda r: (r["conv_id"], r["turn"], r["line"]))
    want = []
    for conv in (1, 2):
        own = [r for r in rows if r[0] == conv]
        want += viterbi(b"".join(observe([x], role=role_of(r)) for _, _, r, x in own))
    assert [r["role"] for r in out] == [ROLES[s // 2] for s in want]


def test_unknown_speakers_and_repeated_rows(spark):
    rows = [(1, 0, "tool", "{}"), (1, 1, "User", "a\nAssistant: b\nc"), (1, 1, "User", "a\nAssistant: b\nc"), (1, 2, " Bob ", "")]
    out = parse_transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), speaker="role").collect()
    assert sorted((r["turn"], r["role"], r["text"], r["opens"]) for r in out) == [(0, "tool", "{}", True), (1, "user", "a\nAssistant: b\nc", True), (1, "user", "a\nAssistant: b\nc", True), (2, "bob", "", True)]
    text = "User: where is it?\nNarrator: they looked around the room.\nAssistant: it is here.\n"
    found = parse_transcripts(spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string")).collect()
    assert [(r["role"], r["text"]) for r in sorted(found, key=lambda r: r["line"])] == [("user", "where is it?"), ("narrator", "they looked around the room."), ("assistant", "it is here.\n")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "User: <|x|> hi"), (2, 1, "user", ""), (2, 1, "user", ""), (2, 2, None, "\n\n"), (3, 0, "User", "y" * 300000)], "conv_id long, turn long, role string, text string")
    out = parse_transcripts(df, speaker="role")
    assert {(r["conv_id"], r["turn"]) for r in out.collect()} == {(None, None), (None, 1), (2, 1), (2, 2), (3, 0)}
    assert any("< |x|>" in r["rendered"] for r in out.collect())
    assert parse_transcripts(df.limit(0)).collect() == []
