"""Job settings (the reference's environment settings, as a frozen dataclass)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class JobConfig:
    # Defaults of the reference settings.
    llm_api_key: str = ""
    llm_model: str = "llama-3.1-8b-instant"
    max_download_bytes: int = 5_000_000
    max_llm_input_chars: int = 60_000
    enable_browser_fallback: bool = True


DEFAULT = JobConfig()
