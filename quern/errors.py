"""What can go wrong, by the stage where it does."""


class QuernError(Exception):
    """Any error of the engine."""


class InvalidDocumentError(QuernError):
    """An upload that validation rejects."""


class EncryptedPdfError(QuernError):
    """A file that cannot be read without a password."""


class PdfExtractionError(QuernError):
    """A file whose pages cannot be read, or that has no text."""


class MissingDocumentError(QuernError):
    """A document that is not stored."""


class EmbeddingError(QuernError):
    """Vectors that are missing, of unlike size or empty."""


class VectorStoreError(QuernError):
    """A table of chunks that is absent or cannot be replaced."""


class RerankError(QuernError):
    """A scorer that answers with another number of scores."""


class GenerationError(QuernError):
    """A chat model without an answer."""
