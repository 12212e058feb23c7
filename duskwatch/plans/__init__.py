"""Registered queries; importing the package registers them all."""
