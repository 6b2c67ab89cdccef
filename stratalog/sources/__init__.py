"""Readers for tables, transcript trees and note vaults."""
