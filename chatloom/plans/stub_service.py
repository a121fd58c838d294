"""A stand-in for the chat-completion service: answers by the annotation rules, for tests and dry runs.

    python -m chatloom.plans.stub_service --port 8000
"""

from __future__ import annotations

import argparse
import json
import re
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from uuid import uuid4

from ..functions.rules import value
from ..operators import annotate as rules

#: Fixed value: where the payload of a prompt lies.
_PAYLOAD = re.compile(r"<<<\s*(\{.*?\})\s*>>>", re.S)


def payload(prompt: str) -> dict:
    """The JSON object between triple angle brackets; empty where there is none or it was ended too early."""
    m = _PAYLOAD.search(prompt)
    try:
        return json.loads(m[1]) if m else {}
    except ValueError:
        return {}


def answer(prompt: str) -> dict:
    """The object that the service returns for a prompt about lines, or about task and language, by the rule tables of the annotation."""
    asked = payload(prompt)
    if '"line_number"' in prompt and '"text"' in prompt:
        return {"lines": [{"line_number": x["line_number"], "label": value(rules.LINE_RULES, "NATURAL_LANGUAGE", str(x["text"]))} for x in asked.get("lines", [])]}
    text = str(asked.get("natural_language_text", prompt))
    with_code = bool(asked.get("metadata", {}).get("original_prompt_contained_code")) if asked else "code" in prompt.lower()
    task, language = value(rules.TASK_RULES, "OTHER", text, with_code), value(rules.LANGUAGE_RULES, "EN", text)
    sure = "LOW" if task == "AMBIGUOUS" else "HIGH"
    return {
        "task_category": task, "task_confidence": sure, "is_code_generation": task in rules.GENERATING, "code_generation_confidence": sure,
        "detected_language": language, "language_confidence": "LOW" if language == "UNKNOWN" else "HIGH", "short_reason": f"{rules.REASON[0]}{task}{rules.REASON[1]}{language}{rules.REASON[2]}",
    }


class Handler(BaseHTTPRequestHandler):
    def _send(self, status: int, body: dict) -> None:
        data = json.dumps(body, ensure_ascii=False).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self) -> None:  # noqa: N802
        if self.path.rstrip("/") == "/v1/models":
            self._send(200, {"object": "list", "data": [{"id": "rules", "object": "model", "created": int(time.time()), "owned_by": "local"}]})
        else:
            self._send(404, {"error": "not found"})

    def do_POST(self) -> None:  # noqa: N802
        if self.path.rstrip("/") != "/v1/chat/completions":
            return self._send(404, {"error": "not found"})
        try:
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            prompt = str(body["messages"][-1]["content"])
        except (ValueError, LookupError, TypeError):
            return self._send(400, {"error": "bad request"})
        content = json.dumps(answer(prompt), ensure_ascii=False, indent=2)
        used = {"prompt_tokens": max(1, len(prompt.split())), "completion_tokens": max(1, len(content.split()))}
        choice = {"index": 0, "message": {"role": "assistant", "content": content}, "finish_reason": "stop"}
        made = {"id": f"chatcmpl-{uuid4().hex[:12]}", "object": "chat.completion", "created": int(time.time()), "model": body.get("model", "rules")}
        self._send(200, made | {"choices": [choice], "usage": used | {"total_tokens": max(1, len(prompt.split()) + len(content.split()))}})

    def log_message(self, *args) -> None:
        pass


def server(port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), Handler)


if __name__ == "__main__":
    p = argparse.ArgumentParser()
    p.add_argument("--port", type=int, default=8000)
    p.add_argument("--host", default="127.0.0.1")
    a = p.parse_args()
    server(a.port, a.host).serve_forever()
