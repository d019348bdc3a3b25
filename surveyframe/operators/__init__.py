"""Operators over tables of questions and cells."""
