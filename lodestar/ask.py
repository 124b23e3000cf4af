"""Labels for numbers by a chat service with an OpenAI-compatible interface; without a key nothing is asked."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Mapping

SYSTEM = "You label phone numbers that a website publishes by the office or service they reach."
TASK = 'Answer with a JSON object: "classification" (a short label, or "Unknown"), "number_kind" ("VOICE", "FAX" or "UNKNOWN"), "confidence" (0 to 1).'
TIMEOUT = 30.0


def parse_reply(content: str) -> dict:
    """classification, number_kind and confidence of a reply; ValueError if it isn't a JSON object."""
    data = json.loads(content)
    if not isinstance(data, dict):
        raise ValueError("the reply isn't an object")
    return {"classification": str(data.get("classification") or "Unknown"), "number_kind": str(data.get("number_kind") or "UNKNOWN").upper(), "confidence": float(data.get("confidence") or 0.5)}


def chat(env: Mapping[str, str] = os.environ) -> Callable[[str], dict] | None:
    """A function from a prompt to its parsed reply; None without a key. Variables: OPENAI_API_KEY, OPENAI_MODEL, OPENAI_BASE_URL."""
    key = env.get("OPENAI_API_KEY")
    if not key:
        return None
    url = f"{env.get('OPENAI_BASE_URL', 'https://api.openai.com/v1').rstrip('/')}/chat/completions"
    model = env.get("OPENAI_MODEL", "gpt-4o-mini")

    def ask(prompt: str) -> dict:
        body = {"model": model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": f"{TASK}\n{prompt}"}]}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            return parse_reply(json.load(answer)["choices"][0]["message"]["content"])

    return ask
