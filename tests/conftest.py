from __future__ import annotations

import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lineguard.session import local_session

    session = local_session("8", memory="6g", checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def png(gray: np.ndarray) -> bytes:
    """A gray 8-bit PNG."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = gray.shape
    raw = b"".join(b"\0" + gray[y].astype(np.uint8).tobytes() for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="session")
def corpus(tmp_path_factory) -> str:
    """80 small PNGs in two classes, plus planted bad files."""
    root = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(7)
    for name, level in (("ok", 90), ("defect", 110)):
        (root / name).mkdir()
        for i in range(40):
            img = np.clip(rng.normal(level, 30, (64, 64)), 0, 255)
            (root / name / f"img_{i:03d}.png").write_bytes(png(img))
    first = (root / "ok" / "img_000.png").read_bytes()
    (root / "ok" / "copy.png").write_bytes(first)
    (root / "ok" / "black.png").write_bytes(png(np.zeros((64, 64))))
    (root / "ok" / "tiny.png").write_bytes(png(np.full((8, 8), 120)))
    (root / "defect" / "broken.png").write_bytes(b"not an image at all")
    (root / "defect" / "empty.png").write_bytes(b"")
    (root / "defect" / "notes.txt").write_bytes(b"text")
    return str(root)
