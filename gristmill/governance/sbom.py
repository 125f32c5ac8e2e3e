"""A list of the installed packages as a CycloneDX 1.5 document."""

from __future__ import annotations

import re
import uuid
from datetime import UTC, datetime
from importlib.metadata import distributions


def package_url(name: str, version: str) -> str:
    return f"pkg:pypi/{re.sub(r'[-_.]+', '-', name).strip('-').lower()}@{version}"


def sbom(root: str = "gristmill", version: str = "0") -> dict:
    """Every installed distribution once, by name, without root, which the document describes."""
    found = {}
    for d in distributions():
        name = (d.metadata["Name"] or "").strip()
        if name and name.lower() != root.lower():
            found.setdefault(name.lower(), {"type": "library", "name": name, "version": d.version or "0.0.0", "purl": package_url(name, d.version or "0.0.0")})
    return {"bomFormat": "CycloneDX", "specVersion": "1.5", "serialNumber": f"urn:uuid:{uuid.uuid4()}", "version": 1, "metadata": {"timestamp": datetime.now(UTC).isoformat(), "component": {"type": "application", "name": root, "version": version}}, "components": [found[k] for k in sorted(found)]}
