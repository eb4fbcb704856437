"""Folders of the test inputs, in a module whose name no other test folder uses."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")
SF0001 = "/root/testdata/sf0.001"
