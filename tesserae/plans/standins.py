"""Models and an OCR engine that need no library, for the queries and tests: they are deterministic and say nothing about quality."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np


class EchoTextModel:
    """Stand-in text model: answers by rule, as JSON in a fence, as a served model would."""

    def load(self):
        def reply(prompts):
            out = []
            for p in prompts:
                task, _, rest = (p or "").partition("\n")
                claims = [s.strip() for s in re.split(r"[.!?]\s*", rest.partition("\x1f")[0]) if len(s.strip()) > 10][:3]
                if task == "claims":
                    out.append("```json\n" + json.dumps(claims) + "\n```")
                elif task == "verify":
                    notice = rest.split("\x1f")[1]
                    results = [{"claim": c, "status": "supported" if c in notice else "inferred" if len(c) % 3 else "contradicted", "evidence": ""} for c in claims]
                    wrong = [r["claim"] for r in results if r["status"] == "contradicted"]
                    out.append(json.dumps({"results": results, "hallucination": bool(wrong), "hallucinated_claims": wrong, "reason": "stub"}))
                else:
                    out.append(json.dumps({"score": str(1 + len(rest) % 5), "reason": "stub"}))
            return out

        return reply


class DigestModel:
    """Stand-in text model whose reply is a digest of the prompt, so that prompts can be compared; it fails where the prompt holds ``fails_on``."""

    def __init__(self, fails_on: str = ""):
        self.fails_on = fails_on

    def load(self):
        def reply(prompts):
            if self.fails_on and any(self.fails_on in (p or "") for p in prompts):
                raise ValueError("no reply to this prompt")
            return ["Reply " + hashlib.md5((p or "").encode()).hexdigest() + " " for p in prompts]

        return reply


class LengthModel:
    """Stand-in classifier of texts by their length modulo 3: a label, an unknown one, no answer."""

    def load(self):
        return lambda texts: [("short", "unheard of", "")[len(t or "") % 3] for t in texts]


class PlainEngine:
    """Stand-in engine without libraries: reads binary portable gray maps (P5) as pictures, whose text is their size, and plain text with form feeds between pages as PDF files."""

    def decode(self, content):
        kind, width, height, most, pixels = content.split(maxsplit=4) if content.count(b" ") >= 3 else (b"", 0, 0, 0, b"")
        if kind != b"P5" or int(most) != 255:
            return None
        return np.frombuffer(pixels[: int(width) * int(height)], dtype=np.uint8).reshape(int(height), int(width))

    def read(self, picture, form):
        return [f"{picture.shape[0]}x{picture.shape[1]}"]

    def pdf_text(self, content):
        return content.decode("utf-8").split("\f")

    def pdf_pictures(self, content, pages):
        return []
