import hashlib
import wave
import zlib
from io import BytesIO

import numpy as np
import pytest

from leafmark.llm import audio
from tests.llm.conftest import HARD


def test_query_round_trip(spark, hard, empty):
    got = audio.op1_audio_features(spark, hard).collect()
    assert len(got) == len(HARD)
    by_text = {}
    for r in got:
        texts = {t or "" for d, t, _, _ in HARD if d == r.doc_id}
        payload = [p for t in texts if hashlib.sha256(p := t.encode() + bytes(-len(t.encode()) % 64 or 64 * (not t))).hexdigest() == r.payload_sha256]
        assert payload and r.payload_bytes == len(payload[0]) and r.payload_bytes % 64 == 0 and r.payload_bytes > 0
        assert r.tail_crc32 == zlib.crc32(payload[0][-64:])
        by_text.setdefault(r.payload_sha256, set()).add((r.n_bytes, r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert audio.op1_audio_features(spark, empty).isEmpty()


def test_stored_form_is_wav(spark):
    df = spark.createDataFrame([(1, "hello " * 1000, "clash")], "doc_id long, text string, media string")
    r = audio.media_columns(df).head()
    with wave.open(BytesIO(r.media)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, 24000)
        assert w.readframes(w.getnframes()) == ("hello " * 1000).encode() + bytes(-6000 % 64)
    batch = audio.read_tensors(r.tensors)
    assert batch.column(0).type.shape == [32, 64] and sum(batch.column(1).to_pylist()) == r.frames
    assert batch.column(2).to_pylist()[0] == 0 and batch.column(3).to_pylist() == sorted(batch.column(3).to_pylist())


@pytest.mark.parametrize("up, down", [(2, 3), (147, 80), (1, 3), (3, 1), (1, 1)])
def test_resampling_keeps_a_tone(up, down):
    t = np.arange(6000) / 6000
    tone = lambda rate: np.sin(2 * np.pi * 200 * np.arange(int(6000 * up / down)) * down / up / 6000)
    y = audio.resample(np.sin(2 * np.pi * 200 * t).astype(np.float32), up, down, 8)
    want = tone(0)[: len(y)]
    edge = 40 * max(1, up // down)
    assert abs(len(y) - 6000 * up / down) <= 1 and np.abs(y[: len(want)] - want)[edge:-edge].max() < 2e-3


def test_resampling_equals_direct_sum():
    x = np.random.default_rng(0).standard_normal(200).astype(np.float32)
    up, down, half = 2, 3, 8
    h = audio._filter(up, down, half)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    whole = np.convolve(stuffed, h)[half * max(up, down) :]
    assert np.allclose(audio.resample(x, up, down, half), whole[::down][: -(-len(x) * up // down)], atol=1e-4)


def test_hysteresis():
    a = audio.Audio()
    x = np.full(16000, 1e-4, np.float32)
    x[4000:8000] = np.sin(np.arange(4000)) * 0.5
    x[12000:12600] = 1.2e-4
    (start, end), = audio.spans(audio.log_mel(x, a), a)
    assert 200 <= start <= 260 and 480 <= end <= 540


def test_mel_filters_cover_the_band():
    f = audio.mel_filters(16000, 512, 64)
    assert f.shape == (257, 64) and (f >= 0).all() and (f.sum(axis=1)[8:235] > 0.5).all()
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFF")


def test_log_mel_is_the_direct_transform():
    a, x = audio.Audio(), np.random.default_rng(3).standard_normal(3000).astype(np.float32)
    window = [0.5 - 0.5 * np.cos(2 * np.pi * i / (a.frame - 1)) for i in range(a.frame)]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(a.new_rate / 2) * k / (a.bands + 1) / 2595) - 1) for k in range(a.bands + 2)]
    got, frames = audio.log_mel(x, a), range(0, len(x) - a.frame + 1, a.hop)
    assert got.shape == (len(frames), a.bands)
    basis = np.exp(-2j * np.pi * np.outer(np.arange(a.fft // 2 + 1), np.arange(a.frame)) / a.fft)
    for row, at in list(enumerate(frames))[::5]:
        power = np.abs(basis @ (x[at : at + a.frame] * window)) ** 2
        for band in range(0, a.bands, 7):
            low, mid, high = edges[band : band + 3]
            total = sum(p * max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid))) for p, f in zip(power, np.arange(len(power)) * a.new_rate / a.fft))
            assert abs(got[row, band] - np.log(total + 1e-6)) < 2e-3


def test_spans_are_those_of_a_state_machine():
    a, r = audio.Audio(), np.random.default_rng(4)
    for _ in range(30):
        loud = np.repeat(r.choice([-12.0, -6.0, -3.0, 0.0, 2.0], 40), r.integers(1, 9, 40))
        mel = np.repeat(loud[:, None], a.bands, axis=1).astype(np.float32)
        level = [10 * np.log10(np.mean([np.exp(v) for v in row])) for row in mel.astype(float)]
        floor, want, begin, reached = np.quantile(level, 0.1), [], None, False
        for i, v in enumerate([*level, -np.inf]):
            if v > floor + a.leave:
                begin, reached = (i if begin is None else begin), reached or v > floor + a.enter
            elif begin is not None:
                start, end = round(begin * a.hop * 1000 / a.new_rate), round(((i - 1) * a.hop + a.frame) * 1000 / a.new_rate)
                if reached and end - start >= a.least_ms:
                    want.append((start, end))
                begin, reached = None, False
        assert audio.spans(mel, a) == want


def test_megabytes_in_one_text(spark, make):
    text = "some words of a long text " * 80_000
    got = {r.doc_id: r for r in audio.op1_audio_features(spark, make([(1, text, "en", "a"), (2, "x", "en", "a")])).collect()}
    assert got[1].n_bytes == len(text) and got[1].payload_bytes == len(text) + -len(text) % 64
    assert got[1].payload_sha256 == hashlib.sha256(text.encode() + bytes(-len(text) % 64)).hexdigest()
