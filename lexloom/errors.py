"""One named error for each way in which a configuration or a row can be bad."""

from __future__ import annotations


class LexloomError(ValueError):
    pass


def _kind(name: str) -> type[LexloomError]:
    return type(name, (LexloomError,), {"__module__": __name__})


UnknownTokenError = _kind("UnknownTokenError")
UnknownIdError = _kind("UnknownIdError")
ConfigError = _kind("ConfigError")
PatternError = _kind("PatternError")
NormalizerError = _kind("NormalizerError")
PreTokenizerError = _kind("PreTokenizerError")
ModelError = _kind("ModelError")
ProcessorError = _kind("ProcessorError")
DecoderError = _kind("DecoderError")
TruncationError = _kind("TruncationError")
PaddingError = _kind("PaddingError")
TrainingError = _kind("TrainingError")
HubError = _kind("HubError")
RecordError = _kind("RecordError")
