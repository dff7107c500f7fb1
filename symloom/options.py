"""Options of an extraction."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ExtractionOptions:
    base_uri: str = "http://dotnet.example/"
    include_private: bool = False
    include_internal: bool = True
    include_compiler_generated: bool = False
    extract_exceptions: bool = True
    extract_see_also: bool = True
    include_attributes: bool = True
    include_external_types: bool = True
    log_level: str = "info"
    #: ``canonical``: every included type is described in full; ``first_touch``: a type that an
    #: earlier type's description mentions stays a stub, as in a sequential walk.
    mode: str = "canonical"
