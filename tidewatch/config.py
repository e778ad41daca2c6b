"""User configuration: names and addresses that appear in results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """``salt`` keys value hashes and acknowledgement tokens; it and the addresses of the response teams have no default."""

    salt: str
    national_team_email: str
    government_team_email: str
    platform: str = "Exposure Desk"
    ack_url: str = "https://localhost/api/ack/"

    def __post_init__(self) -> None:
        if not self.salt:
            raise ValueError("Settings.salt must not be empty")
        if not (self.national_team_email and self.government_team_email):
            raise ValueError("Settings needs the addresses of both response teams")
