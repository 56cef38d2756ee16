"""Pieces, groups, turns, tokens and sentences."""

import random

import pytest

from parlance.llm import groups, pieces, sentences, tokens, turns


def test_cut():
    assert pieces.cut(0, 20_000, []) == [(0, 20_000, "end")]
    assert pieces.cut(0, 60_000, []) == [(0, 27_500, "hard"), (26_500, 54_000, "hard"), (53_000, 60_000, "end")]
    assert pieces.cut(0, 40_000, [5_000, 27_500, 27_501])[0] == (0, 27_500, "boundary")
    assert pieces.cut(0, 40_000, [900])[0] == (0, 27_500, "hard")
    with pytest.raises(ValueError):
        pieces.cut(0, 1, [], overlap=27_500)
    r = random.Random(1)
    for _ in range(200):
        end, cuts = r.randrange(1, 200_000), sorted(r.randrange(200_000) for _ in range(r.randrange(30)))
        out = pieces.cut(0, end, cuts)
        assert out[0][0] == 0 and out[-1][1] == end and all(0 < b - a <= 27_500 for a, b, _ in out)
        for (a, b, how), (c, _, _) in zip(out, out[1:]):
            assert c == b - 1_000
            best = max((x for x in cuts if a + 2_000 <= x <= a + 27_500), default=None)
            assert (b, how) == ((best, "boundary") if best else (a + 27_500, "hard"))


def test_pieces(spark):
    chunks = [("a", "R1 ", 0.0, 40.0, None, "one two three four"), ("a", "R1 ", 0.0, 40.0, None, "one two three four"), ("b", "r1", 0.0, None, 30_000.0, None), ("c", "R1", None, 27.5, 27.5, "x"), ("d", None, None, None, None, "x"), ("e", "R2", None, None, 60.0, "x y"), (None, "R1", 0.0, 90.0, None, "x")]
    units = [("R1", 0.0, 10.0, "one"), ("R1", 12.0, 20.0, "two"), ("R1", 19.0, 25.0, "three"), ("R1", 30.0, 40.0, "four"), ("R1", 30.0, 20.0, "bad"), ("R1", None, 5.0, None), ("R1", 0.0, 500.0, "wrong")]
    c = spark.createDataFrame([(*x, 7) for x in chunks], "example_id string, recording string, start double, end double, duration double, text string, units int")
    u = spark.createDataFrame(units, "recording string, start double, end double, text string")
    got = {}
    for x in pieces.oversized_pieces(c, u).orderBy("example_id", "piece").collect():
        got.setdefault(x["example_id"], []).append((x["start_ms"], x["end_ms"], x["cut"], x["text"]))
    assert sorted(got) == ["a", "b", "e"]
    # the unit of 500 s goes on at each end within it, so nothing is left but hard cuts
    assert [x[2] for x in got["a"]] == ["hard", "end"]
    sane = pieces.oversized_pieces(c, u.where("text <> 'wrong'")).where("example_id = 'a'").orderBy("piece").collect()
    assert [tuple(x)[2:] for x in sane] == [(0, 25_000, "boundary", "one two three"), (24_000, 40_000, "end", "four")]
    assert [x[2] for x in got["e"]] == ["hard", "hard", "end"]
    assert pieces.oversized_pieces(c, u.limit(0)).where("example_id = 'a'").count() == 2
    assert pieces.oversized_pieces(c.limit(0), u).count() == 0


def test_hash_to_min(spark):
    r = random.Random(2)
    # a hub, a long chain and random links
    edges = [("hub", f"h{i}") for i in range(60)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [(f"x{r.randrange(80)}", f"x{r.randrange(80)}") for _ in range(60)] + [("q", "q"), (None, "z")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {x["node"]: x["component"] for x in groups.hash_to_min(spark.createDataFrame(edges * 2, "a string, b string")).collect()}
    assert got == {n: find(n) for n in parent}
    assert groups.hash_to_min(spark.createDataFrame([], "a string, b string")).count() == 0


def test_splits(spark):
    recs = spark.createDataFrame([(f"R{i}", float(i % 13), "train") for i in range(300)] + [("R1", 5.0, None), (None, 1.0, None), ("R300", None, None)], "recording string, duration double, split string")
    people = spark.createDataFrame([("R1", " SPK-1"), ("r2 ", "spk-1 "), ("R2", "SPK-2"), ("R3", "SPK-2"), ("R4", "UNKNOWN"), ("R5", "unknown"), ("R6", None), ("R7", ""), ("R8", "n/a"), ("R9", "N/A")], "recording string, speaker_id string")
    chunks = spark.createDataFrame([("r1 ", "dev"), ("R3", "train"), ("R4", "train"), ("R5", "test"), ("R6", None), ("R10", "Train "), ("R10", "train"), ("R11", "dev"), ("R11", "validation")], "recording string, split string")
    assert sorted(x[0] for x in groups.torn_recordings(recs, people, chunks).collect()) == ["R1", "R2", "R3"]
    got = groups.assign_splits(recs, people).collect()
    assert len(got) == 301 and len({x["split"] for x in got if x["recording"] in ("R1", "R2", "R3")}) == 1
    total = sum(x["seconds"] for x in got)
    for split, share in groups.TARGETS.items():
        assert sum(x["seconds"] for x in got if x["split"] == split) / total == pytest.approx(share, abs=0.05)
    assert groups.assign_splits(recs.limit(0), people).count() == 0
    # a further recording moves no more than the weights that change demand
    more = recs.unionByName(spark.createDataFrame([("R999", 60.0)], "recording string, duration double"), allowMissingColumns=True)
    before, after = ({x["recording"]: x["split"] for x in d.collect()} for d in (groups.assign_splits(recs, people), groups.assign_splits(more, people)))
    assert sum(after[k] != v for k, v in before.items()) <= 15


TRANSCRIPT = "﻿Tape A\nTopic: the pond\n[00:01] ANNA: we went um home [laughter]\r\nand back\n@Situation:\tbreak\n%com: x\n*BER: yes\nthe thing is: no\nu:m (.) @@@\nAna: [00:09] at 12:49 right\nB / anna: both 30988_31888\nall: hey\n(1:02) Berta; mm\nah:m we stay\nBetra : end.\n"


def test_turns(spark):
    model = turns.train([("1", TRANSCRIPT, ["Anna", "BERTA"])] * 5)
    want = [("Anna", 3, 4), ("BERTA", 7, 8), ("Anna", 10, 10), ("BERTA/Anna", 11, 11), ("ALL", 12, 12), ("BERTA", 14, 15)]
    assert [x[:3] for x in turns.turns(TRANSCRIPT, ["Anna", "BERTA"], turns.Boosted())] != want
    got = turns.turns(TRANSCRIPT, ["Anna", "BERTA"], model)
    assert [x[:3] for x in got] == want
    assert got[0][3] == "we went home and back" and got[3][3] == "both"
    rows = [(1, ["Anna", "BERTA"], TRANSCRIPT, None), (1, ["Anna", "BERTA"], TRANSCRIPT, None), (2, ["Anna"], None, "Anna: yes"), (3, ["Anna"], "", "Anna: no"), (4, None, "Anna: x", None), (5, ["Anna", None, ""], None, None), (None, ["Anna"], "Anna: x", None), (6, ["Anna"], "Anna: " + "word " * 40_000, None)]
    df = spark.createDataFrame([(*x, 3) for x in rows], "transcript_id long, speakers array<string>, raw_text string, text string, turn int")
    found = turns.speaker_turns(df).orderBy("transcript_id", "turn").collect()
    assert [(x["speaker"], x["line_start"], x["line_end"]) for x in found if x["transcript_id"] == 1] == want
    assert {x["transcript_id"] for x in found} == {1, 2, 6}
    assert turns.speaker_turns(df.limit(0)).count() == 0


def test_held_out_labels():
    """Decisions on misspelled and shortened labels that the training has not seen."""
    names = ["Gavrel", "Sunnive", "Orskel", "Tolven", "Mirelle", "Yorvik"]
    r = random.Random(7)

    def transcript(people, spoilt):
        lines = []
        for _ in range(40):
            k = r.random()
            said = f"they moved the pond near {r.choice(['here', 'there'])}"
            if k < 0.3:
                lines.append(("  " if k < 0.1 else "") + (f"so then: {said}" if k < 0.05 else said))
                continue
            n = r.choice(people)
            if spoilt:
                i = r.randrange(1, len(n) - 2)
                n = r.choice([n[:3], n[:i] + n[i + 1] + n[i] + n[i + 2 :], n.lower()])
            lines.append(f"{n}: {said}")
        return "\n".join(lines)

    def accuracy(model):
        r.seed(8)
        right = total = 0
        for _ in range(20):
            lines = turns.read_lines(transcript(names[3:], True), turns.Names(names[3:]))
            labelled = [x for x in lines if x.label is not None]
            for x, p in zip(labelled, model.probability(turns.features(lines))):
                right += (p >= 0.5) == (" " not in x.label)
                total += 1
        return right / total

    some = [(str(i), transcript(names[:3], False), names[:3]) for i in range(20)]
    assert accuracy(turns.train(some)) >= 0.98 > 0.95 > accuracy(turns.Boosted())


def test_long_joint_labels():
    names = ["Bartholomew Featherstonehaugh", "Wilhelmina Cholmondeley-Warner", "Maximilian Throckmorton"]
    text = "\n".join(f"{n}: we moved the pond" for n in [*names, "/".join(names), "Wilhelmina", "so it was said by those who came here from far away with all of their things in a cart that was much too small"] * 4)
    got = turns.turns(text, names, turns.train([("a", text, names)]))
    assert [x[0] for x in got[:5]] == [*names, "/".join(names), names[1]] and got[4][1:3] == (5, 6)


def test_tokens(spark):
    enc = tokens._encoding(tokens.DEFAULT_RANKS)
    r = random.Random(8)
    for _ in range(800):
        s = "".join(r.choice(r.choice(["ab", "the ing", "日本語", "aé", " "])) for _ in range(r.randrange(1, 200))).encode()
        assert tokens.encode_unsplit(enc, s, leaf=r.choice([4, 9, 40]), window=r.choice([1, 2, 8])) == enc._encode_single_piece(s)
    bits = ["ab", " the", "ing ", "日本", "，", "é", "  ", "\n", "'s", "'", "don't", " 3", "4", "!?", " ！", "\u3000", "\u00a0", "\t", " . ", "ไทย", "हि", "’s", "'ll'"]
    for _ in range(3_000):
        s = "".join(r.choice(bits) for _ in range(r.randrange(1, 120)))
        assert tokens.encode_tree(enc, s, leaf=r.choice([2, 5, 9, 20]), reach=r.choice([1, 2, 4])) == enc.encode_ordinary(s)
    with pytest.MonkeyPatch.context() as m:
        # without the windows around the joins, the halves' own tokens stay
        m.setattr(tokens, "join_texts", lambda enc, text, at, left, right, leaf, reach: left + right)
        assert tokens.encode(enc, "antidisestablishmentarianism" * 201) != enc.encode_ordinary("antidisestablishmentarianism" * 201)
    texts = ["", None, " ", "<|endoftext|> it's", "a" * 30_000 + " b", "字" * 9_000, "don't " * 900, "\r\n\n  x　y" * 500]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {x["doc_id"]: x["ids"] for x in tokens.encode_corpus(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (enc.encode_ordinary(t) if t else [])
        assert not t or enc.decode(got[i]) == t
    assert tokens.encode_corpus(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, parts",
    [
        ("Dr. Lee met Mr. Po at 3 p.m. near here. He left at 4 p.m. They stayed.", ["Dr. Lee met Mr. Po at 3 p.m. near here.", "He left at 4 p.m.", "They stayed."]),
        ("“One. Two!” said Ann. ‘Three. It’s four,’ said Bo.", ["“One. Two!” said Ann.", "‘Three. It’s four,’ said Bo."]),
        ('He told us, "Go now?" They went.', ['He told us, "Go now?"', "They went."]),
        ("Play clip_1.wav from X, i.e. the v2.7 cut. Entry No. 30 weighed 3.5 kg.", ["Play clip_1.wav from X, i.e. the v2.7 cut.", "Entry No. 30 weighed 3.5 kg."]),
        ("A roof ... and then more… but no… Then end?!", ["A roof ... and then more… but no…", "Then end?!"]),
        ("Heading here\n\n1. First line.\n2. Second\nline\n10. Odd", ["Heading here", "1. First line.", "2. Second\nline\n10. Odd"]),
        ("ANN: yes.\nBOB: no\nCr. Po: well", ["ANN: yes.", "BOB: no", "Cr. Po: well"]),
        ("It ended.Another began.Mrs. Po came", ["It ended.", "Another began.", "Mrs. Po came"]),
        ("Am 3. Mai kam z. B. Frau Po. „Ja. Gut!“ sagte sie.", ["Am 3. Mai kam z. B. Frau Po.", "„Ja. Gut!“ sagte sie."]),
        ("« Oui. Non! » disait M. Po. Fin", ["« Oui. Non! » disait M. Po.", "Fin"]),
        ("Πού πάμε; Εδώ π.χ. με τον κ. Βρασόλη.", ["Πού πάμε;", "Εδώ π.χ. με τον κ. Βρασόλη."]),
        ("В 1987 г. ещё с др. Врелиным. Да!", ["В 1987 г. ещё с др. Врелиным.", "Да!"]),
        ("「はい。いいえ？」と言った。次は二つ！", ["「はい。いいえ？」と言った。", "次は二つ！"]),
        ("他说：“走。好？”然后他走了。我在v2.1版。", ["他说：“走。好？”然后他走了。", "我在v2.1版。"]),
        ("यह डॉ. वरेला है। “हाँ। ना?” ऐसा उसने कहा।", ["यह डॉ. वरेला है।", "“हाँ। ना?” ऐसा उसने कहा।"]),
        ("مع د. فريلان؛ ثم عادوا. «نعم. لا؟» هكذا قالت.", ["مع د. فريلان؛ ثم عادوا.", "«نعم. لا؟» هكذا قالت."]),
        ("กลุ่มฟัง 56.5 คน เขาไป\n\nเรามา", ["กลุ่มฟัง 56.5 คน", "เขาไป", "เรามา"]),
        ("先生が来た 昨日わたしたちは聞いた", ["先生が来た", "昨日わたしたちは聞いた"]),
        ("橋を見ました昨日わたしたちは聞いた", ["橋を見ました", "昨日わたしたちは聞いた"]),
        ("他走了 后来他们回家", ["他走了", "后来他们回家"]),
        ("我喜欢这个 他们的书", ["我喜欢这个 他们的书"]),
        ("He said สวัสดี ครับ to them", ["He said", "สวัสดี", "ครับ", "to them"]),
        ("Adm. Jones met Maj. Po. He left.", ["Adm. Jones met Maj. Po.", "He left."]),
        ("one\r\ntwo. Three\r\n\r\nfour", ["one\r\ntwo.", "Three", "four"]),
        ("(He said so. Yes.) Then [a. B] it (approx. 3.5 m) ended", ["(He said so. Yes.) Then [a. B] it (approx. 3.5 m) ended"]),
        ("…", ["…"]),
        ("🙂", ["🙂"]),
    ],
)
def test_sentences(text, parts):
    assert [text[a:b] for a, b in sentences.sentences(text)] == parts


def test_sentences_cover(spark):
    r = random.Random(9)
    bits = ["Dr.", "word", "Word", ".", "?", "…", "“", "”", '"', "(", ")", "\n", "\n\n", "\r\n", " ", "3", "p.m.", "。", "」", "「", "ไทย", "字", " ", "​", ";", "1.", "A:"]
    for _ in range(500):
        t = "".join(r.choice(bits) for _ in range(r.randrange(40)))
        at = 0
        for a, b in sentences.sentences(t):
            assert a >= at and not t[at:a].strip() and t[a:b] == t[a:b].strip() != ""
            at = b
        assert not t[at:].strip()
    rows = [(1, "One. Two", "letter"), (2, "one\ntwo\r\n\nthree. four", "captions"), (3, None, "letter"), (4, "", None), (5, " \n ", None), (6, "Aa bb. " * 20_000, None)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, kind string, start_char int")
    got = {}
    for x in sentences.sentence_units(df, with_text=True).orderBy("doc_id", "start_char").collect():
        got.setdefault(x["doc_id"], []).append(x["sentence"])
    assert got[1] == ["One.", "Two"] and got[2] == ["one", "two", "three. four"] and sorted(got) == [1, 2, 6] and len(got[6]) == 20_000
    assert sentences.sentence_units(df.limit(0)).count() == 0


def test_word_lattice():
    assert sentences.word_lattice("橋を見ました")[-1] == "ました"
    assert sentences.word_lattice("昨天我们") == ["昨天", "我们"]
    # with a public vocabulary, あなた ends in a longer word than the particle た
    words = sentences.dictionary()
    assert len(words) > 500 and sentences.word_lattice("ここにいるのはあなた", words)[-1] == "なた" != sentences.word_lattice("ここにいるのはあなた")[-1]
    try:
        sentences.use_words(words)
        assert len(sentences.sentences("ここにいるのはあなた 昨日の話")) == 1
        sentences.use_words(sentences.dictionary(None))
        assert len(sentences.sentences("ここにいるのはあなた 昨日の話")) == 2
    finally:
        sentences._WORDS.clear()
        sentences._last_word.cache_clear()
        sentences._first_word.cache_clear()
    assert sentences.word_lattice("") == []
