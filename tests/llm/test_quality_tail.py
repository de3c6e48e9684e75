"""The last bytes of a long text count in the chunk rule as those of any other chunk."""

import zstandard

from basaltql.llm import quality


def test_tail_has_a_chunk_of_its_own():
    compressor = zstandard.ZstdCompressor(level=3)
    ratio = lambda raw: 4096 / len(compressor.compress(raw))
    text = " ".join(str(i * i) for i in range(1500))[:6000] + "é" * 1000
    raw = text.encode()
    assert quality.measure(1, text, compressor)[-2:] == (ratio(raw[-4096:]), ratio(raw[:4096]))
    assert quality.measure(1, "a" * 1023, compressor)[-2:] == (None, None)
    short = raw[:2500].decode()
    parts = [1024 / len(compressor.compress(raw[i : i + 1024])) for i in (0, 1024, 1476)]
    assert quality.measure(1, short, compressor)[-2:] == (max(parts), min(parts))
    even = (raw + raw)[:8192].decode(errors="ignore").replace("é", "ee")[:8192]
    parts = [ratio(even.encode()[i : i + 4096]) for i in (0, 4096)]
    assert len(even) == 8192 and quality.measure(1, even, compressor)[-2:] == (max(parts), min(parts))
