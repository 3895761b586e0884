"""Small sources written for the tests, one project that is like a real one."""

PROJECT = {
    "shop/app.py": '''"""Entry of the shop."""

from config import load, check
from models import Cart, Gift


def create(path):
    """Build the shop."""
    settings = load(path)
    if not check(settings):
        raise ValueError("bad")
    return settings


def serve(cart, action):
    cart.validate()
    print(action)
    return step(action)


def step(action):
    return {"action": action}


def main():
    shop = create("x.yaml")
    gift = Gift("a")
    serve(gift, "go")
''',
    "shop/config.py": '''"""Settings."""

import os
from pathlib import Path

LIMIT = 10
PLACE: str = "x"


def load(path):
    """Read settings."""
    text = Path(path).read_text()
    return text


def check(settings):
    return bool(settings)
''',
    "shop/models.py": '''from dataclasses import dataclass


class Base:
    def validate(self):
        return True


class Cart(Base):
    """Things to buy."""

    @property
    def size(self, *args, **more):
        return 1


class Gift(Cart):
    def __init__(self, name):
        super().__init__()
        self.name = name

    def wrap(self, paper):
        return paper
''',
}
