"""A client of a remote OCR service, as an engine for images.py.

The service takes a form with a message (JSON) and a file, and answers with the fields that it has read in the picture. Pictures are sent
as PNG, which needs no library. Rate limits and failures of the service or the network are waited for in TRIES tries, ever
longer or as long as the service says; what it refuses otherwise is an error at once.
"""

from __future__ import annotations

import json
import struct
import time
import urllib.error
import urllib.request
import uuid
import zlib
from dataclasses import dataclass

import numpy as np

from tesserae.operators.images import Engine

TRIES = 5
# Fixed values of the service's interface: header of the key, version, names of the message and of the answer.
KEY_HEADER, VERSION = "X-OCR-SECRET", "V2"


def png(picture: np.ndarray) -> bytes:
    """A picture of height x width or height x width x 3 bytes as a PNG file."""
    rows = np.ascontiguousarray(picture, dtype=np.uint8)
    height, width, depth = rows.shape[0], rows.shape[1], 3 if rows.ndim == 3 else 1
    lines = np.zeros((height, 1 + width * depth), dtype=np.uint8)  # each line after the number of its filter, 0: none
    lines[:, 1:] = rows.reshape(height, -1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if depth == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def form(message: dict, content: bytes, name: str) -> tuple[str, bytes]:
    """(content type, body) of a form with a message and a file."""
    edge = uuid.uuid4().hex
    parts = [
        f'--{edge}\r\nContent-Disposition: form-data; name="message"\r\nContent-Type: application/json\r\n\r\n{json.dumps(message)}\r\n'.encode(),
        f'--{edge}\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode(),
        content,
        f"\r\n--{edge}--\r\n".encode(),
    ]
    return f"multipart/form-data; boundary={edge}", b"".join(parts)


@dataclass
class RemoteOcr:
    """Reads pictures by the service at ``url``; files are decoded by another engine. A missing address or key is an error when it is made."""

    url: str
    key: str
    files: Engine
    timeout: float = 30.0
    wait: float = 1.0

    def __post_init__(self):
        if not self.url or not self.key:
            raise RuntimeError("the OCR service needs an address and a key")

    def decode(self, content: bytes) -> np.ndarray | None:
        return self.files.decode(content)

    def pdf_text(self, content: bytes) -> list[str | None]:
        return self.files.pdf_text(content)

    def pdf_pictures(self, content: bytes, pages: int) -> list[np.ndarray]:
        return self.files.pdf_pictures(content, pages)

    def read(self, picture: np.ndarray, form_name: str) -> list[str]:
        """The texts that are not blank, in the service's order."""
        message = {"images": [{"format": "png", "name": "ocr"}], "requestId": str(uuid.uuid4()), "version": VERSION, "timestamp": round(time.time() * 1000)}
        answer = self._sent(*form(message, png(picture), "ocr.png"))
        return [t for f in answer["images"][0].get("fields", []) if (t := f.get("inferText", "")).strip()]

    def _sent(self, kind: str, body: bytes) -> dict:
        for attempt in range(TRIES):
            request = urllib.request.Request(self.url, body, {KEY_HEADER: self.key, "Content-Type": kind})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as error:
                if attempt == TRIES - 1 or error.code != 429 and error.code < 500:
                    raise
                said = error.headers.get("Retry-After", "")
                time.sleep(float(said) if said.isdigit() else self.wait * 2**attempt)
            except urllib.error.URLError:
                if attempt == TRIES - 1:
                    raise
                time.sleep(self.wait * 2**attempt)
        raise AssertionError("unreachable")
