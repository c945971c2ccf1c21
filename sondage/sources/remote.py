"""HTTP: pages as documents behind an address check, embedding and chat services with retries."""

from __future__ import annotations

import http.client
import ipaddress
import json
import socket
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

from sondage.errors import EmbedderUnavailable, InvalidInput

MAX_BYTES, MAX_REDIRECTS = 10 << 20, 10
LONGEST_WAIT = 8.0


def public_address(url: str, allow_private: bool = False, resolve: Callable = socket.getaddrinfo) -> str:
    """The address to connect to. Raises InvalidInput unless the URL is http(s) and all its addresses are public."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise InvalidInput(f"{url} is no http or https URL")
    try:
        found = [a[4][0] for a in resolve(parts.hostname, parts.port or (443 if parts.scheme == "https" else 80), type=socket.SOCK_STREAM)]
    except OSError as e:
        raise InvalidInput(f"{parts.hostname} has no address: {e}") from e
    for address in found:
        ip = ipaddress.ip_address(address.split("%")[0])
        ip = getattr(ip, "ipv4_mapped", None) or ip
        if not allow_private and (not ip.is_global or ip.is_multicast):
            raise InvalidInput(f"{parts.hostname} is at {address}", "private and local addresses are not fetched")
    if not found:
        raise InvalidInput(f"{parts.hostname} has no address")
    return found[0]


def _request(url: str, address: str, timeout: float) -> tuple[int, str, str, bytes]:
    """Status, location, content type and body, from the address that was checked and no other."""
    parts = urlsplit(url)
    port = parts.port or (443 if parts.scheme == "https" else 80)
    sock = socket.create_connection((address, port), timeout)
    if parts.scheme == "https":
        sock = ssl.create_default_context().wrap_socket(sock, server_hostname=parts.hostname)
    link = http.client.HTTPConnection(parts.hostname, port, timeout=timeout)
    link.sock = sock
    try:
        link.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"Accept": "text/html,text/plain,*/*", "User-Agent": "sondage"})
        answer = link.getresponse()
        return answer.status, answer.getheader("Location") or "", answer.getheader("Content-Type") or "", answer.read(MAX_BYTES + 1)
    finally:
        link.close()


def fetch(url: str, allow_private: bool = False, timeout: float = 30, resolve: Callable = socket.getaddrinfo) -> tuple[str, str]:
    """(content type, body): every redirect is checked like the first URL; 10 MiB at most."""
    for _ in range(MAX_REDIRECTS + 1):
        status, location, kind, body = _request(url, public_address(url, allow_private, resolve), timeout)
        if status in (301, 302, 303, 307, 308) and location:
            url = urljoin(url, location)
            continue
        if status != 200:
            raise InvalidInput(f"{url} answered {status}")
        if len(body) > MAX_BYTES:
            raise InvalidInput(f"{url} is over {MAX_BYTES} bytes")
        return kind, body.decode("utf-8", "replace")
    raise InvalidInput(f"over {MAX_REDIRECTS} redirects", url)


def _post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def with_retries(call: Callable[[], dict], retries: int, backoff: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """``retries + 1`` attempts, waits doubling up to 8 s; only unreachable services and 5xx answers are tried again."""
    for attempt in range(retries + 1):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code < 500 or attempt == retries:
                raise EmbedderUnavailable(f"the service answered {e.code}") from e
        except (urllib.error.URLError, OSError) as e:
            if attempt == retries:
                raise EmbedderUnavailable(f"the service can't be reached: {e}") from e
        sleep(min(LONGEST_WAIT, backoff * 2**attempt))
    raise AssertionError


def endpoint(url: str, name: str) -> str:
    """``<base>/api/<name>`` for any of a service's addresses."""
    return url.rstrip("/").split("/api/")[0].removesuffix("/api") + f"/api/{name}"


@dataclass(frozen=True)
class RemoteEmbedder:
    """``embed`` of EmbedderConfig; shipped to tasks. A batch that fails is tried text by text, a text that fails is None."""

    url: str
    model: str
    dims: int | None = 768
    timeout: float = 120
    retries: int = 2
    backoff: float = 0.5

    def _ask(self, texts: list[str]) -> list[list[float]]:
        body = {"model": self.model, "input": texts} | ({"dimensions": self.dims} if self.dims else {})
        found = with_retries(lambda: _post(endpoint(self.url, "embed"), body, self.timeout), self.retries, self.backoff)["embeddings"]
        if len(found) != len(texts):
            raise EmbedderUnavailable(f"{len(found)} vectors for {len(texts)} texts")
        return found

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        try:
            return self._ask(texts)
        except (EmbedderUnavailable, KeyError, ValueError):
            out: list[list[float] | None] = []
            for text in texts if len(texts) > 1 else []:
                try:
                    out += self._ask([text])
                except (EmbedderUnavailable, KeyError, ValueError):
                    out.append(None)
            return out or [None] * len(texts)


def chat(url: str, model: str, prompt: str, timeout: float = 120) -> str:
    """One answer of a chat service, not streamed."""
    body = {"model": model, "messages": [{"role": "user", "content": prompt}], "stream": False}
    return with_retries(lambda: _post(endpoint(url, "chat"), body, timeout), 0)["message"]["content"]
