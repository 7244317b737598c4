"""What can be wrong with inputs."""


class SkymatchError(Exception):
    pass


class DuplicateId(SkymatchError):
    pass


class InvalidDimensions(SkymatchError):
    pass


class InvalidAxis(SkymatchError):
    pass


class AlreadySet(SkymatchError):
    pass


class Uninitialized(SkymatchError):
    pass


class CorruptedFile(SkymatchError):
    pass


class InvalidPosition(SkymatchError):
    pass


class WrongFormat(SkymatchError):
    pass


class MissingData(SkymatchError):
    pass
