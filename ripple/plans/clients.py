"""HTTP clients: labels from a chat service, comments on a pull request. Every failure of a label is a None."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable

from ..sources.config import LabelSettings
from .labels import LabelClient, answer_detail

PROMPT = (
    "You explain one code edit to a reviewer. Answer with JSON {\"detail\": \"...\"}: at most two sentences on why the edit matters. "
    "Name only identifiers from the evidence, in backticks. No risk words, no counts of hops, no preamble."
)
Send = Callable[[str, str, dict, dict | None, int], object]


def send(method: str, url: str, headers: dict, body: dict | None = None, timeout: int = 60) -> object:
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json", **headers}, method=method)
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read() or b"null")


class ChatClient:
    """A service with the chat completions interface (also local ones)."""

    def __init__(self, settings: LabelSettings, send: Send = send):
        self.settings, self.send = settings, send

    def label(self, pack: dict) -> str | None:
        s = self.settings
        body = {"model": s.model, "temperature": 0, "messages": [{"role": "system", "content": PROMPT}, {"role": "user", "content": json.dumps(pack)}]}
        try:
            got = self.send("POST", f"{s.base_url.rstrip('/')}/chat/completions", {"Authorization": f"Bearer {s.api_key}"}, body, 60)
            return answer_detail(got["choices"][0]["message"]["content"])
        except (OSError, ValueError, KeyError, IndexError, TypeError):
            return None


class MessagesClient:
    """A service with the messages interface."""

    def __init__(self, settings: LabelSettings, send: Send = send):
        self.settings, self.send = settings, send

    def label(self, pack: dict) -> str | None:
        s = self.settings
        body = {"model": s.model, "max_tokens": 300, "system": PROMPT, "messages": [{"role": "user", "content": json.dumps(pack)}]}
        try:
            got = self.send("POST", f"{s.base_url.rstrip('/')}/messages", {"x-api-key": s.api_key}, body, 20)
            return answer_detail(got["content"][0]["text"])
        except (OSError, ValueError, KeyError, IndexError, TypeError):
            return None


def build_client(settings: LabelSettings) -> LabelClient | None:
    """By provider; None without a model or an address, or for an unknown provider."""
    if not settings.model or not settings.base_url:
        return None
    kinds = {"openai": ChatClient, "ollama": ChatClient, "anthropic": MessagesClient}
    return kinds[settings.provider](settings) if settings.provider in kinds else None


class PullRequestComments:
    """Comments of one pull request: list, create, update."""

    def __init__(self, api: str, token: str, repository: str, number: int, send: Send = send):
        self.base, self.repository, self.number, self.send = f"{api.rstrip('/')}/repos/{repository}", repository, number, send
        self.api, self.token, self.headers = api, token, {"Authorization": f"Bearer {token}"}

    def list(self) -> list[dict]:
        """All pages, so that an old report is found among many comments."""
        out, page = [], 1
        while got := self.send("GET", f"{self.base}/issues/{self.number}/comments?per_page=100&page={page}", self.headers, None, 60):
            out += got
            page += 1
            if len(got) < 100:
                break
        return out

    def create(self, body: str) -> None:
        self.send("POST", f"{self.base}/issues/{self.number}/comments", self.headers, {"body": body}, 60)

    def update(self, comment: int, body: str) -> None:
        self.send("PATCH", f"{self.base}/issues/comments/{comment}", self.headers, {"body": body}, 60)

    def delete(self, comment: int) -> None:
        """One that another attempt has deleted is no error."""
        try:
            self.send("DELETE", f"{self.base}/issues/comments/{comment}", self.headers, None, 60)
        except urllib.error.HTTPError as e:
            if e.code != 404:
                raise

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, send: Send = send) -> PullRequestComments:
        """Token, repository and number from the variables of a workflow run; the number also from its event file."""
        env = dict(os.environ) if env is None else env
        number = env.get("PR_NUMBER") or _number(env.get("GITHUB_EVENT_PATH"))
        missing = [k for k, v in (("GITHUB_TOKEN", env.get("GITHUB_TOKEN")), ("GITHUB_REPOSITORY", env.get("GITHUB_REPOSITORY")), ("PR_NUMBER", number)) if not v]
        if missing:
            raise ValueError(f"not set: {', '.join(missing)}")
        return cls(env.get("GITHUB_API_URL", "https://api.github.com"), env["GITHUB_TOKEN"], env["GITHUB_REPOSITORY"], int(number), send)


def _number(path: str | None) -> str | None:
    try:
        with open(path) as f:
            event = json.load(f)
    except (OSError, ValueError, TypeError):
        return None
    got = (event.get("pull_request") or {}).get("number") or event.get("number")
    return str(got) if got else None
