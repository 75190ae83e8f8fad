"""Chroma alignment against brute force by bit errors, and recordings whose prints repeat."""

import numpy as np

from tideline.llm import audio


def brute_force(prints, queries):
    """Every query and recording with an overlap, at any offset, of enough prints and few enough differing bits."""
    out = {}
    for q in queries:
        for i, y in prints.items():
            x = prints[q]
            for d in range(audio.MIN_FRAMES - len(x), len(y) - audio.MIN_FRAMES + 1):
                a, b = x[max(0, -d) :][: len(y) - max(0, d)], y[max(0, d) :][: len(x) - max(0, -d)]
                wrong = int(np.bitwise_count((a ^ b).view(np.uint32)).sum())
                if min(len(a), len(b)) >= audio.MIN_FRAMES and wrong <= audio.MAX_ERRORS * 32 * len(a):
                    out.setdefault((q, i), {})[d] = wrong / (32 * len(a))
    return out


def matched(spark, prints, queries):
    table = spark.createDataFrame([(k, p.tolist()) for k, p in prints.items()], "id long, prints array<int>")
    return {(r.query_id, r.match_id): r for r in audio.matches(table, spark.createDataFrame([(q,) for q in queries], "id long")).collect()}


def melody(seed, n=40):
    return audio.tune(np.random.default_rng(seed).uniform(-0.3, 0.3, n))


def test_every_alignment_of_noisy_recordings_is_found(spark):
    r = np.random.default_rng(3)
    prints = {}
    for k in range(5):
        clean = melody(k)
        prints[20 * k] = audio.fingerprint(audio.wav(clean))
        for j, p in enumerate((0.05, 0.08, 0.11, 0.14, 0.17, 0.19), 1):  # evenly spread bit errors
            flips = (r.random((len(prints[20 * k]), 32)) < p) @ (1 << np.arange(32, dtype=np.uint64))
            prints[20 * k + j] = prints[20 * k] ^ flips.astype(np.uint32).view(np.int32)
        for j, noise in enumerate((0.02, 0.1, 0.2, 0.4), 7):  # noise in the sound, later starts
            late = clean[r.integers(0, len(clean) // 2) :]
            prints[20 * k + j] = audio.fingerprint(audio.wav(0.6 * (late + r.normal(0, noise, len(late)))))
    want = brute_force(prints, range(0, 100, 20))
    got = matched(spark, prints, range(0, 100, 20))
    assert set(got) == set(want) and len(want) > 45 and sum(min(w.values()) > 0.1 for w in want.values()) > 15
    assert all(abs(want[k][r.offset] - r.bit_errors) < 1e-9 for k, r in got.items())


def random_prints(seed, n):
    return np.random.default_rng(seed).integers(1, 1 << 31, n).astype(np.int32)


def test_repeated_prints_count_at_every_place(spark):
    x, y, held = random_prints(1, 30), random_prints(2, 25), np.repeat(random_prints(3, 1), 40)
    prints = {1: np.concatenate([x, x, y]), 2: np.concatenate([x, y]), 3: held, 4: held, 5: held[:30]}
    got = matched(spark, prints, [2, 4])
    assert set(got) == {(2, 1), (2, 2), (4, 3), (4, 5)}
    assert got[2, 1].offset == 30 and got[2, 1].bit_errors == 0 and got[2, 1].votes == 50
    assert got[4, 3].copies == 2 and got[4, 3].offset == 0 and got[4, 3].votes == 35
    assert got[4, 5].offset == 0 and got[4, 5].bit_errors == 0 and got[4, 5].votes == 25


def test_silence_matches_nothing(spark):
    silent, a, b = np.zeros(60, dtype=np.int32), random_prints(4, 30), random_prints(5, 30)
    got = matched(spark, {1: silent, 2: np.concatenate([silent, a]), 3: np.concatenate([silent, b])}, [1, 2])
    assert set(got) == {(2, 2)} and got[2, 2].offset == 0


def test_recordings_of_few_prints_match_their_copies_and_what_holds_them(spark):
    clip = melody(7)
    whole = audio.fingerprint(audio.wav(clip))
    start = 30 * audio.HOP
    prints = {1: whole, **{k: audio.fingerprint(audio.wav(clip[start : start + audio.FRAME + (frames - 1) * audio.HOP])) for k, frames in ((2, 20), (3, 20), (4, 34))}}
    assert [len(prints[k]) for k in (2, 3, 4)] == [5, 5, 19]
    got = matched(spark, prints, [2, 4])
    assert {(2, 1), (2, 2), (2, 4), (4, 1), (4, 2), (4, 4)} == set(got)
    assert got[2, 2].copies == 2 and got[2, 2].bit_errors == 0 and got[4, 4].bit_errors == 0 and got[4, 1].offset == 30
    assert brute_force({k: p for k, p in prints.items() if k == 1}, [1]).keys() == {(1, 1)}


def sound(rate, high):
    """A melody of notes below 1 kHz, with a tone at ``high`` Hz that ``audio.RATE`` can't hold, if given."""
    t = np.arange(8 * rate) / rate
    notes = 130.81 * 2 ** (np.random.default_rng(8).integers(0, 30, 32) / 12)
    return 0.4 * np.sin(2 * np.pi * notes[(t * 4).astype(int)] * t) + (0.3 * np.sin(2 * np.pi * high * t) if high else 0)


def test_recordings_of_other_rates_have_the_same_prints():
    want = audio.fingerprint(audio.wav(sound(audio.RATE, 0)))
    for rate, high in ((16000, 3000), (8000, 2700), (44100, 9000), (48000, 0), (11025, 4000)):
        got = audio.fingerprint(audio.wav(sound(rate, high), rate))
        assert len(got) == len(want) > 100
        assert np.bitwise_count((got ^ want).view(np.uint32)).sum() < 0.03 * 32 * len(want)
    assert len(audio.fingerprint(audio.wav(sound(2000, 0), 2000))) == len(want)
    assert len(audio.unwav(audio.wav(np.ones(3), 48000))) == 1 and len(audio.unwav(audio.wav(np.ones(0), 8000))) == 0 and audio.unwav(audio.wav(np.ones(9), 0)) is None


def test_channels_are_fewer_than_bits_and_never_understate_what_two_prints_share():
    tunes = [audio.fingerprint(audio.wav(melody(k))) for k in range(6)]
    for prints in (tunes, [random_prints(9, 50), random_prints(10, 60)], [np.repeat(random_prints(11, 1), 30)]):
        axes, every = audio._axes(prints), np.concatenate(prints)
        bound = audio._channels(every, axes) @ audio._channels(every, axes).T
        assert (bound >= 32 - 2 * np.bitwise_count((every[:, None] ^ every).view(np.uint32)).astype(int) - 1e-4).all()
        assert audio._channels(every, axes).shape[1] < 32
    assert audio._channels(every, axes).shape[1] == 2  # one print alone has one axis


def test_alignments_of_recordings_of_many_lengths_are_those_of_brute_force():
    r = np.random.default_rng(12)
    whole = [audio.fingerprint(audio.wav(melody(k))) for k in range(3)] + [random_prints(k, 100) for k in range(13, 16)]
    prints = []
    for k in range(130):
        p = whole[k % 6][r.integers(0, 40) :][: r.integers(25, 90)]
        prints.append(p ^ ((r.random((len(p), 32)) < 0.09) @ (1 << np.arange(32, dtype=np.uint64))).astype(np.uint32).view(np.int32))
    want = brute_force(dict(enumerate(prints)), range(12))
    got = {(q, i): (d, errors) for q, i, d, _, errors in audio.aligned(prints[:12], prints)}
    assert set(got) == set(want) and len(want) > 20
    assert all(abs(want[k][d] - errors) < 1e-9 for k, (d, errors) in got.items())
